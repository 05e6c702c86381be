"""Assignments in many syntaxes: texts are made with the spans that they must give."""

from __future__ import annotations

import random
import time

import pytest
from test_edges import prose
from test_literals import key

from corvane.llm import secrets
from corvane.llm.assignments import assignments

SENSITIVE = ["db_pwd", "privateKey", "AUTH", "client.credentials", "user-passphrase", "signing_key", "bearerValue"]
PLAIN = ["title", "colour", "homePage", "width", "authority", "monkey"]
NEUTRAL = ["k1", "part_b", "tmpC", "valueD"]
#: How a name takes a quoted literal; {n} is the name, {v} the literal.
QUOTED = [
    '{n} = "{v}"', "{n} = '{v}'", "{n}: '{v}',", '{n} := "{v}"', '  "{n}": "{v}",', "'{n}' => '{v}',", 'settings["{n}"] = "{v}";', 'set("{n}", "{v}")', 'conf.put( "{n}" , "{v}" );', "<{n}>{v}</{n}>",
    '<add key="{n}" value="{v}"/>', '<entry name="{n}">{v}</entry>', '{n} = """{v}"""', 'String {n} = "{v}";', 'val {n}: String = "{v}"', 'let {n}: &str = "{v}";', "{n} = b'{v}'", "{n} = `{v}`", 'char {n}[] = "{v}";', '{n}("{v}")', '{n} = str("{v}")', 'open(host="h", {n}="{v}")',
]
BARE = ["{n}={v}", "export {n}={v}", "tool --{n}={v} run", "{n} = {v}", "- {n}: {v}  # note", "{n}: {v}"]
#: Where the same names and literals assign nothing.
NOTHING = ['# {n} = "{v}"', "// {n}: '{v}'", '/* {n} = "{v}" */', '<!-- <{n}>{v}</{n}> -->', "The {n}: {v} said so.", 'if {n} == "{v}":', "says {n} and {v} too", '"{n} = {v}"']


def usable(name: str, form: str) -> bool:
    return name.isidentifier() or not any(x in form for x in ("<{n}>", "String", "val ", "let ", "char", "{n}("))


def test_made_texts():
    r = random.Random(21)
    for _ in range(400):
        text, want = "", []

        def put(form: str, n: str, v: str, found: bool) -> None:
            nonlocal text
            at = len(text) + form.replace("{n}", n).index("{v}")
            text += form.replace("{n}", n).replace("{v}", v) + "\n"
            if found:
                want.append((at, at + len(v)))

        for _ in range(r.randint(1, 8)):
            kind, v = r.random(), key(r.randint(16, 60)).replace("+", "x").replace("/", "y") + "7aZ"
            n = r.choice(SENSITIVE)
            if kind < 0.35:
                form = r.choice([f for f in QUOTED if usable(n, f)])
                put(form, n, v, True)
            elif kind < 0.5:
                put(r.choice(BARE), n, v, True)
            elif kind < 0.65:
                put(r.choice([f for f in NOTHING if usable(n, f)]), n, v, False)
            elif kind < 0.8:
                n = r.choice(PLAIN)
                put(r.choice([f for f in QUOTED if usable(n, f)]), n, v, False)
            else:
                text += prose(12, r.randrange(999)) + ".\n"
        got = sorted((s.start, s.end) for s in secrets.literal_spans(text))
        assert got == sorted(want), text


def test_names_are_followed_in_any_order():
    r = random.Random(22)
    for _ in range(200):
        n = r.randint(1, 9)
        names = [f"n{k}x" for k in range(n)]
        values = [key(20).replace("+", "x").replace("/", "y") for _ in names]
        parent = [r.randrange(k) if k and r.random() < 0.6 else None for k in range(n)]
        uses = r.randrange(n)
        lines = [(f'{names[k]} = "{values[k]}"' + (f" + {names[p]}" if p is not None else ""), k) for k, p in enumerate(parent)] + [(f"db_pwd = {names[uses]}", None)]
        r.shuffle(lines)
        text = "\n".join(x for x, _ in lines) + "\n"
        want, k = [], uses
        while k is not None:
            want.append((text.index(values[k]), text.index(values[k]) + len(values[k])))
            k = parent[k]
        assert sorted((s.start, s.end) for s in secrets.literal_spans(text)) == sorted(want), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('k = "Zk39fLq0"\nk += "aPw8XyZ1"\ndb_pwd = k', ["Zk39fLq0", "aPw8XyZ1"]),
        ("db_pwd = first\nfirst = second\nsecond = 'Zk39fLq0aPw8'", ["Zk39fLq0aPw8"]),
        ("A=Zk39fLq0aPw8\nexport AUTH=${A}", ["Zk39fLq0aPw8"]),
        ("a = b\nb = a\ndb_pwd = a + 'Zk39fLq0aPw8'", ["Zk39fLq0aPw8"]),
        ("db_pwd = (\n  'Zk39fLq0'\n  'aPw8XyZ1'\n)", ["Zk39fLq0", "aPw8XyZ1"]),
        ('db_pwd = getenv("DB", "Zk39fLq0aPw8")', ["Zk39fLq0aPw8"]),
        ('private_key = """-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"""', ["-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"]),
        ("```python\ndb_pwd = 'Zk39fLq0aPw8'\n```", ["Zk39fLq0aPw8"]),
        ("The auth: Government-2020 said", []),
        ("auth: Zk39fLq0aPwM0=\n", ["Zk39fLq0aPwM0="]),
    ],
)
def test_syntaxes(text, want):
    assert [text[s.start : s.end] for s in sorted(secrets.literal_spans(text), key=lambda s: s.start)] == want


def test_long_odd_texts_are_read_in_linear_time():
    n = 4000
    for text in ("/*", "<!--", '"', "'a", "<a ", "ab-", "a.b", "k=", "pwd = (", "pwd(", 'pwd = "a" + ', "``", "pwd: ", "a->", "#", "pwd ", "pwd[", "pwd = a\n", "$", "pwd=$", '"""', "pwd = '''", "key", "key.", "key a", "<a>b", "pwd:x|"):
        start = time.perf_counter()
        assignments(text * n + " db_pwd: x")
        secrets.may_assign(text * n)
        assert time.perf_counter() - start < 1, text
