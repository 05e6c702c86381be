"""Names that hold the story, line scores against a plain version, and pages that are deep or full of tags."""

from __future__ import annotations

import math
import random
import time

import pytest
from test_edges import prose
from test_marks import MENU, STORY, body

from corvane.llm import html


@pytest.mark.parametrize("attrs", ["class='post login'", "id=tags", "class=search", "class='header'", "class=social", "class='widget share'", "id=sidebar", "class=modal"])
def test_a_name_around_the_story_is_no_reason(attrs):
    want = "\n\n".join(STORY)
    assert html.main_text(f"<body><div {attrs}>{body(STORY)}</div></body>") == want
    assert html.main_text(f"<body><ul>{MENU}</ul><div {attrs}>{body(STORY)}<div class=sidebar>{body(['see also ' + prose(15, 7)])}</div></div><ul>{MENU}</ul></body>") == want


def test_names_beside_the_story_are():
    for attrs in ("class=sidebar", "id=cookie-consent", "class=comments", "class='login'", "class='related-posts'", "class=ads"):
        page = f"<body><ul>{MENU}</ul><div>{body(STORY)}</div><div {attrs}>{body([prose(60, 8)] * 3)}</div></body>"
        assert html.main_text(page) == "\n\n".join(STORY), attrs
    assert html.main_text(f"<body><div class=comments>{body(STORY)}</div></body>") == ""
    assert html.main_text(f"<body><article><p>{STORY[0]}</p><div class='comment-list'>{body(STORY[1:])}</div></article></body>") == STORY[0]


def plain_chosen(lines) -> list[bool]:
    """The same rules, line by line."""
    n = len(lines)
    size = [len(x[0]) for x in lines]
    link = [min(x[2], len(x[0])) for x in lines]
    ratio = [math.log(1 + (s - k) / (1 + x[1])) for s, k, x in zip(size, link, lines)]
    reach = range(-3, 4) if n > 6 else range(-n, n + 1)
    even = []
    for i in range(n):
        near = [(math.exp(-0.5 * d * d), ratio[i + d]) for d in reach if 0 <= i + d < n]
        even.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    low, high = min(even), max(even)
    if high > low + 0.5:
        for _ in range(50):
            at = (low + high) / 2
            a, b = [x for x in even if x <= at], [x for x in even if x > at]
            if not a or not b or (sum(a) / len(a), sum(b) / len(b)) == (low, high):
                break
            low, high = sum(a) / len(a), sum(b) / len(b)
        keep = [x > (low + high) / 2 for x in even]
    else:
        keep = [True] * n
    plain = [k <= 0.5 * s for k, s in zip(link, size)]
    keep = [k and p for k, p in zip(keep, plain)]
    first = [i for i in range(n) if keep[i]]
    for a, b in zip(first, first[1:]):
        if b - a <= 4:
            for i in range(a + 1, b):
                keep[i] = plain[i]
    for i in first:
        while i and lines[i - 1][4] and plain[i - 1] and not keep[i - 1]:
            i -= 1
            keep[i] = True
    marked = [x[3] for x in lines]
    if any(marked) and sum(s for s, m in zip(size, marked) if m) >= sum(s for s, m, k in zip(size, marked, keep) if k and not m):
        keep = marked
    return keep


def test_lines_are_scored_as_the_plain_version_does():
    r = random.Random(8)
    for k in range(300):
        lines = []
        for _ in range(r.randint(1, 40)):
            size = r.choice([3, 12, 80, 300])
            lines.append(("x" * size, r.randint(0, 6), r.choice([0, 0, size // 2, size]), k % 3 == 0 and r.random() < 0.4, r.random() < 0.2, 0))
        assert html.chosen(lines) == plain_chosen(lines)


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "</p>" * 50_000, "<div>" * 100_000 + "deep", "<section><pre>" * 50_000 + "x", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<ul><li>" * 50_000 + "<p>" * 50_000, "<div class=ad>" * 50_000 + "text", "<p>a<b>" * 50_000, "<h1>" * 50_000 + "<p>x" * 50_000])
def test_time_grows_with_the_page(page):
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 12
