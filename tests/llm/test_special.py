"""Special tokens are those of the file, whatever they look like."""

from __future__ import annotations

import json

import numpy as np

from corvane.llm.bpe import Codec, default_path
from corvane.llm.packing import Words


def test_special_tokens_of_another_look(tmp_path):
    from tokenizers import Tokenizer

    spec = json.loads(open(default_path(), encoding="utf-8").read())
    names = {"<|startoftext|>": "[BEGIN]", "<|endoftext|>": "</s>"}
    for x in spec["added_tokens"]:
        x["content"] = names.get(x["content"], x["content"])
    spec["model"]["vocab"] = {names.get(k, k): v for k, v in spec["model"]["vocab"].items()}
    spec["post_processor"] = None
    spec["model"]["unk_token"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["a [BEGIN]b</s> c", "</s>", "[BEGIN][BEGIN]", "<|endoftext|> is text here", "[begin] too", "plain"]
    library, codec, words = Tokenizer.from_file(str(path)), Codec(str(path)), Words(str(path))
    for text, ids in zip(texts, words.all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want and np.frombuffer(ids, "<u4").tolist() == want, text
