"""Chat formatting: roles of transcript lines by a hidden Markov model, and turns in one canonical form.

A transcript is plain text whose speakers are marked in many ways, on some turns not at all. Each line
is in a state, a role and whether it begins a turn; it shows features: the kind of its speaker marker,
a blank line before it, its length, how it begins and ends. Starts, transitions and features are counted on a
bounded sample of labelled transcripts; the Viterbi path gives the roles.

A conversation of any length has one path. It is stored in parts of PART turns: each part is first folded into
a matrix of its best scores from any state before it to any state at its end, the matrices of a conversation give
the states at its parts' borders, and each part is then decoded between them. That is the path of the whole.
A turn that goes on over a border is written on without a new head, so the parts' renderings joined are the whole's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_SPACE, batches, written

#: Labelled transcripts that the model is fitted on, at most.
SAMPLE = 600
#: Turns in a part; only matrices of parts meet in one place.
PART = 256
#: Words that mark speakers, and styles that transcripts are written in.
MARKERS = {
    "user": "user human question customer instruction input prompt me q".split(),
    "assistant": "assistant ai bot answer response output agent model a".split(),
    "system": "system instructions context setup".split(),
}
STYLES = ({"user": "User: ", "assistant": "Assistant: ", "system": "System: "}, {"user": "Human: ", "assistant": "AI: ", "system": "System: "}, {"user": "### Instruction:\n", "assistant": "### Response:\n", "system": "### System:\n"}, {"user": "[Q] ", "assistant": "[A] ", "system": "[Context] "})
_KIND = {w: i + 1 for i, words in enumerate(MARKERS.values()) for w in words}
_MARKER = re.compile(r"(?:#{1,4}|\*{1,2}|<\|?|\[)?[ \t]*([A-Za-z]{1,12})(?:[ \t]*(?:\|?>|\]|\*{0,2}:\*{0,2}))[ \t]*")
_LOOKS = (6, 2, 5, 2, 3)  # numbers of values of each feature


def marker(line: str) -> tuple[int, int]:
    """Kind of the speaker marker that a line begins with (0: none, 1-3: of a role, 4: of an unknown name) and its length."""
    m = _MARKER.match(line)
    if not m or not (m[0].rstrip()[-1] in ":>]"):
        return 0, 0
    return _KIND.get(m[1].lower(), 4), m.end()


def looks(lines: list[str]) -> np.ndarray:
    """The features of each line that isn't blank; blank lines are only seen by the next."""
    out, blank, bare = [], 1, 0
    for line in lines:
        if not line.strip(WORD_SPACE):
            blank, bare = 1, 0
            continue
        kind, size = marker(line)
        rest = line[size:].strip(WORD_SPACE)
        out.append((kind + (5 - kind) * (kind == 0 and bare), blank, min(4, len(rest).bit_length() // 2), int(rest.endswith("?")), 0 if not rest else 1 + rest[0].isupper()))
        blank, bare = 0, kind > 0 and not rest
    return np.array(out, np.int64).reshape(-1, len(_LOOKS))


class Model:
    """Counts with one added to each, as logarithms."""

    def __init__(self, roles: list[str], samples: list[tuple[np.ndarray, np.ndarray]]):
        """samples: features and states (2 * role, one more where no turn begins) of lines."""
        self.roles = roles
        n = 2 * len(roles)
        start, step, shown = np.ones(n), np.full((n, n), 0.1), [np.full((n, k), 0.5) for k in _LOOKS]
        for x, s in samples:
            if len(s):
                start[s[0]] += 1
                np.add.at(step, (s[:-1], s[1:]), 1)
                for f, table in enumerate(shown):
                    np.add.at(table, (s, x[:, f]), 1)
        for role in range(len(roles)):  # a line that begins no turn goes on with the turn before
            step[[s for s in range(n) if s // 2 != role], 2 * role + 1] = 1e-9
            start[2 * role + 1] = 1e-9
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(1, keepdims=True))
        self.shown = [np.log(t / t.sum(1, keepdims=True)) for t in shown]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(t[:, x[:, f]] for f, t in enumerate(self.shown)).T

    def entries(self) -> np.ndarray:
        """Scores of a first state after each state, and in the last row of one that nothing comes before."""
        return np.concatenate([self.step, self.start[None]])

    def fold(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best scores of paths over the lines from each state before them (the last row: none) to each at their end, and the first states of these paths."""
        out = self.entries() + self.scores(x[:1])
        first = np.broadcast_to(np.arange(out.shape[1]), out.shape)
        for score in self.scores(x[1:]) if len(x) > 1 else ():
            to = out[:, :, None] + self.step
            by = to.argmax(1)
            out, first = np.take_along_axis(to, by[:, None], 1)[:, 0] + score, np.take_along_axis(first, by, 1)
        return out, first

    def path(self, x: np.ndarray, entry: int | None = None, leave: int | None = None) -> np.ndarray:
        """The most likely states, by Viterbi's recursion; between the states before and at the end where they are given."""
        if not len(x):
            return np.zeros(0, np.int64)
        score = self.scores(x)
        best, back = (self.start if entry is None else self.entries()[entry]) + score[0], np.zeros((len(x), len(self.start)), np.min_scalar_type(len(self.start)))
        lines = np.arange(len(self.start))
        for i in range(1, len(x)):
            to = best[:, None] + self.step
            back[i] = to.argmax(0)
            best = to[back[i], lines] + score[i]
        out = np.zeros(len(x), np.int64)
        out[-1] = best.argmax() if leave is None else leave
        for i in range(len(x) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def borders(self, folds: list[tuple[np.ndarray, np.ndarray] | None]) -> list[tuple[int, int, bool, bool]]:
        """Of each part of a conversation, of the parts' folds (None: no line) in order: the states before it and at its end, whether it begins within a turn and whether it ends within one."""
        n = len(self.start)
        best, back = np.append(np.full(n, -np.inf), 0.0), []
        for fold in folds:
            if fold is None:
                back.append(np.arange(n + 1))
                continue
            to = best[:, None] + fold[0]
            back.append(np.append(to.argmax(0), n))
            best = np.append(to.max(0), -np.inf)
        at, after, out = int(best.argmax()), False, []
        for fold, b in zip(reversed(folds), reversed(back), strict=True):
            entry = int(b[at])
            within = after if fold is None else entry < n and int(fold[1][entry, at]) % 2 == 1
            out.append((entry, at, within, after))
            at, after = entry, within
        return out[::-1]

    def turns(self, transcript: str, entry: int | None = None, leave: int | None = None) -> tuple[list[tuple[str, str]], np.ndarray]:
        """Roles and texts of the turns, and the state of each line that isn't blank. Lines lose white space at their ends, and blank lines within a turn are one.

        entry: the state before the transcript; where that turn goes on, the first turn has its text but not its head (see rendered).
        """
        lines, out = transcript.split("\n"), []
        path = self.path(looks(lines), entry, leave)
        at = iter(path.tolist())
        for line in lines:
            if not line.strip(WORD_SPACE):
                if out and out[-1][1][-1]:
                    out[-1][1].append("")
                continue
            s = next(at)
            kind, size = marker(line)
            role = self.roles[s // 2]
            if s % 2 == 0 or not out or out[-1][0] != role:
                out.append((role, []))
                line = line[size if kind in (1, 2, 3) and s % 2 == 0 else 0 :].lstrip(WORD_SPACE if s % 2 == 0 else "")
            out[-1][1].append(line.rstrip(WORD_SPACE))
        return [(r, "\n".join(x).strip("\n")) for r, x in out], path


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def rendered(turns: list[tuple[str, str]], goes_on: bool, continued: bool, hollow: bool = False) -> str:
    """The turns of a part in canonical form: the first without a head where it goes on from the part before (hollow: of which there is no text yet), the last without an end where it is continued."""
    gap = "" if hollow else "\n\n"
    return "".join((gap if goes_on and not k else f"<|{r}|>\n") + t + ("" if continued and k == len(turns) - 1 else "\n<|end|>\n") for k, (r, t) in enumerate(turns))


def ends_bare(lines: list[str]) -> bool:
    """Whether the last line that isn't blank is a role's marker alone."""
    last = next((x for x in reversed(lines) if x.strip(WORD_SPACE)), "")
    kind, size = marker(last)
    return kind in (1, 2, 3) and not last[size:].strip(WORD_SPACE)


def parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `part`: their place in the order within their conv_id, in steps of PART.

    Rows are dealt by ranges of conversation and order, so that no conversation comes together in one task; each
    task numbers its rows, and only its numbers of rows by conversation meet.
    """
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("task", F.spark_partition_id())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "place long"])

    def number(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches_:
            out = []
            for c in b.column("conv_id").to_pylist():
                if not n or c != last:
                    last, n = c, 0
                out.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "place"])

    placed, _ = written(dealt.mapInArrow(number, schema), "turns")
    sizes = placed.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    shift, _ = written(sizes.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("task")) - F.col("n")).alias("shift")), "shifts")
    out = placed.join(shift, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")))
    place = F.col("place") + F.col("shift")
    return out.withColumn("part", F.floor(place / PART)).withColumn("place", place).drop("task", "c", "k", "shift")


def transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, transcript, roles, n: lines of each turn that aren't blank) of conversations written as plain text.

    The style goes by conversation; one turn in five has no marker. Turns are in order of turn, role and
    text; null roles are written as users', null texts as empty, null conv_ids are one conversation, repeated rows are
    turns of their own; an empty table gives an empty one. A part holds PART turns.
    """
    r = F.coalesce(F.col(role), F.lit("user"))
    t = F.coalesce(F.col(text), F.lit(""))
    style = F.pmod(F.xxhash64(F.col(conv)), F.lit(len(STYLES)))
    named = F.lit("")
    for i, s in enumerate(STYLES):
        mark = F.concat(F.initcap(r), F.lit(": "))
        for k, v in s.items():
            mark = F.when(r == k, F.lit(v)).otherwise(mark)
        named = F.when(style == i, mark).otherwise(named)
    bare = F.pmod(F.xxhash64(F.col(conv), F.col(turn)), F.lit(5)) == 0
    told = F.concat(F.when(bare, F.lit("")).otherwise(named), t)
    full = F.size(F.filter(F.split(told, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != ""))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), told.alias("told"), full.alias("n"), F.monotonically_increasing_id().alias("row"))
    numbered = parts(rows, ["turn", "role", "told", "row"]).select("conv_id", "part", F.struct("place", "role", "told", "n").alias("x"))
    whole = numbered.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", "part", F.array_join(F.transform("x", lambda x: x["told"]), "\n\n").alias("transcript"), F.transform("x", lambda x: x["role"]).alias("roles"), F.transform("x", lambda x: x["n"]).alias("n"))


def labels(roles: list[str], told: list[str], n: list[int]) -> np.ndarray:
    """The states of lines, of turns' roles and numbers of lines."""
    out: list[int] = []
    for r, k in zip(told, n, strict=True):
        if k:
            s = 2 * roles.index(r)
            out += [s, *[s + 1] * (k - 1)]
    return np.array(out, np.int64)


def fitting() -> Column:
    """Whether a conversation is one that models may be fitted on: half of them, by a hash. The others tell how good a model is."""
    return F.pmod(F.xxhash64("conv_id", F.lit("fit")), F.lit(2)) == 0


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the roles in at most `sample` labelled parts of transcripts, those of smallest hash. Equal parts count each; an empty table gives a model of nothing but the features' names."""
    order = F.xxhash64("conv_id", "part")
    rows = labelled.select("transcript", "roles", "n", order.alias("o")).orderBy("o", "transcript").limit(sample).toArrow().to_pylist()
    roles = sorted({"user", "assistant"} | {x for r in rows for x in r["roles"]})
    samples = [(looks(r["transcript"].split("\n")), labels(roles, r["roles"], r["n"])) for r in rows]
    return Model(roles, samples)


def format_chats(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, n_turns (that begin in the part), roles (of these, joined), rendered (canonical form) and states (of lines) of each (conv_id, part, transcript) row.

    The parts of a conversation, in order, are decoded as one transcript. Null and empty transcripts have no turn; null conv_ids
    are one conversation; (conv_id, part) pairs must differ. An empty table gives an empty one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = len(model.start)

    def fold(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(batches_):
            lines = [(t or "").split("\n") for t in b.column(2).to_pylist()]
            seen, bare = [looks(x) for x in lines], [ends_bare(x) for x in lines]
            folds = [model.fold(x) if len(x) else None for x in seen]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([f and f[k].astype(t).tobytes() for f in folds], pa.binary()) for k, t in enumerate((np.float64, np.uint8))), pa.array(bare)], names=["conv_id", "part", "best", "first", "bare"])

    names = ["conv_id", "part", "entry", "leave", "within", "after", "hollow"]

    def border(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, at = [], [], None
        for b in batches_:
            for conv, part, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and conv != at:
                    out += between(at, held)
                    held = []
                at = conv
                held.append((part, *told))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        out += between(at, held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kinds = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]

    def between(conv, held: list[tuple]) -> list[tuple]:
        """The borders of one conversation's parts, which come in order."""
        folds = [best and (np.frombuffer(best, np.float64).reshape(n + 1, n), np.frombuffer(first, np.uint8).reshape(n + 1, n)) for _, best, first, _ in held]
        out, empty = [], False
        for (part, _, _, bare), fold, (entry, leave, within, after) in zip(held, folds, model.borders(folds), strict=True):
            out.append((conv, part, entry, leave, within, after, empty))
            empty = empty if fold is None else bare and leave % 2 == 0
        return out

    def decode(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(batches_):
            out: list[list] = [[], [], [], []]
            for t, entry, leave, within, after, hollow in zip(*(b.column(k).to_pylist() for k in range(2, 8)), strict=True):
                turns, states = model.turns(t or "", entry, leave)
                own = turns[within:]
                for x, y in zip(out, (len(own), ",".join(r for r, _ in own), rendered(turns, within, after, hollow), states.tolist()), strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["conv_id", "part", "n_turns", "roles", "rendered", "states"])

    part = f"conv_id {kind}, part long"
    asked = rows.select("conv_id", F.col("part").cast("long").alias("part"), "transcript")
    folds, _ = written(asked.mapInArrow(fold, f"{part}, best binary, first binary, bare boolean"), "folds")
    found = folds.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(border, f"{part}, entry int, leave int, within boolean, after boolean, hollow boolean")
    found, _ = written(found.withColumnsRenamed({"conv_id": "c", "part": "p"}), "borders")
    both = asked.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "part", "transcript", "entry", "leave", "within", "after", "hollow")
    return both.mapInArrow(decode, f"{part}, n_turns long, roles string, rendered string, states array<int>")


def agreement(told: DataFrame, labelled: DataFrame, roles: list[str]) -> DataFrame:
    """told with n_lines, held_out (whether no model was fitted on the conversation) and, for those, n_right: lines whose role is the labelled one, else null. Null conv_ids are one conversation, which stays."""
    index = F.array(*[F.lit(r) for r in roles])
    true = F.flatten(F.transform(F.arrays_zip("true_roles", "n"), lambda x: F.array_repeat((F.array_position(index, x["true_roles"]) - 1).cast("int"), x["n"])))
    known = labelled.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), F.col("roles").alias("true_roles"), "n")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("part").eqNullSafe(F.col("__part"))
    both = told.join(known, same).drop("__conv", "__part").withColumn("true", true).withColumn("held_out", ~fitting())
    right = F.size(F.filter(F.zip_with(F.transform("states", lambda s: F.floor(s / 2).cast("int")), "true", lambda a, b: a == b), lambda x: x))
    return both.withColumn("n_lines", F.size("true").cast("long")).withColumn("n_right", F.when(F.col("held_out"), right.cast("long"))).drop("true_roles", "true", "n", "states")
