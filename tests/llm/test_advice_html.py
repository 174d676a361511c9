"""Page text: tags end where HTML says, whatever their length."""

from doclens.llm import html_density

BODY = "<body><article><p>First words of the text, as long as they need be.</p>{}<p>Last words of the text, also quite long.</p></article>"
WANT = "First words of the text, as long as they need be.\n{}Last words of the text, also quite long."


def test_long_tags():
    for n in (10, 1990, 2100, 30_000):
        value = "<b>x</b> => " + "y" * n
        assert html_density.extract(BODY.format(f"<p data-props='{value}'>Middle of it.</p>")) == WANT.format("Middle of it.\n")
        assert html_density.extract(BODY.format(f'<div onclick="{value}" class="sidebar">Beside it.</div>')) == WANT.format("")


def test_quotes():
    assert html_density.extract(BODY.format('<p title="never closed>Middle of it.</p>')) == WANT.format("Middle of it.\n")
    assert html_density.extract(BODY.format("<p title=it's>Middle o'it.</p>")) == WANT.format("Middle o'it.\n")
    assert html_density.extract(BODY.format("""<p data-x='<i class="nav" hidden>'>Middle of it.</p>""")) == WANT.format("Middle of it.\n")
    assert html_density.extract("<p " + 'a="b" ' * 5000) is not None
