"""Pages whose marks or names say less than their text."""

from __future__ import annotations

from test_edges import prose

from corvane.llm.html import main_text

STORY = [prose(70, 300 + k) for k in range(7)]
MENU = "".join(f"<li><a href=/{k}>go {k}</a></li>" for k in range(12))


def body(texts: list[str]) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


def test_a_story_outside_a_marked_teaser_stays():
    page = f"<body><ul>{MENU}</ul><article>{body(STORY[:2])}</article><div class=story>{body(STORY[2:])}</div><ul>{MENU}</ul></body>"
    text = main_text(page)
    assert all(t in text for t in STORY[2:]) and "go 3" not in text


def test_marks_bound_the_content():
    page = f"<body><ul>{MENU}</ul><main>{body(STORY)}<p>Short.</p></main><div>{prose(20, 9)}</div></body>"
    assert main_text(page) == "\n\n".join([*STORY, "Short."])


def test_names_count_as_wholes():
    for name in ("content has-sidebar", "overflow-hidden", "no-header"):
        assert main_text(f"<body><div class='{name}'>{body(STORY)}</div></body>") == "\n\n".join(STORY)
    assert main_text(f"<body><div>{body(STORY)}</div><div class='box sidebar'>{body(STORY[:1])}</div></body>") == "\n\n".join(STORY)


def test_no_name_removes_the_article():
    assert main_text(f"<body><div class=widget><p>by</p><article>{body(STORY)}</article></div></body>") == "\n\n".join(STORY)
    text = main_text(f"<body><div>{body(STORY)}</div><div id=comments><article>{body(['a reply ' + prose(30, 4)])}</article></div></body>")
    assert text == "\n\n".join(STORY)
