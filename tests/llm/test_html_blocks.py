import numpy as np

from rolegrid.llm import html_blocks as h

PAGES = "page_id long, url string, html string"
ARTICLE = "<article><h1>A &amp; B</h1><p>one<b>two</b>  three\n four<br>five</p><p>x &lt;y&gt; &#233;</p></article>"


def text(page):
    return h.main_text(page, h.trained())


def test_blocks_and_decoding():
    want = "A & B onetwo three four five x <y> é"
    assert text(f"<html><head><title>T</title><style>p{{}}</style></head><body>{ARTICLE}</body></html>") == want
    noise = ('<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">b</a></li></ul></nav><!-- <p>no</p> -->'
             '<header><p>Site name here</p></header><div class="cookie-notice"><p>We use cookies on this site.</p></div>')
    tail = ('<aside><p>More words to read in the side part</p></aside><form><p>Write to us</p><input value="x">'
            '<button>Send</button></form><section id="comments"><div class="comment"><p>A reader says this is a long '
            'enough text to look like a paragraph of the article itself.</p></div></section>'
            "<footer>&copy; somebody, all rights</footer><script>var a='<p>z</p>';</script>")
    assert text(f"<body>{noise}{ARTICLE}{tail}</body>") == want
    assert text(f"<body>{noise}<main>{ARTICLE}<div class='ad'>Buy now this thing</div></main>{tail}") == want


def test_pages_told_by_density_alone():
    long = "many words make a paragraph of running text that goes on and on for a while " * 3
    menu = "<div>" + " | ".join(f'<a href="/{i}">part {i}</a>' for i in range(6)) + "</div>"
    page = f"<body><table>{menu}<p>{long}</p><p>{long}</p><p>a short one of five words</p><p>{long}</p>{menu}</table>"
    clean = " ".join(long.split())
    assert text(page) == f"{clean} {clean} a short one of five words {clean}"


def test_odd_pages():
    assert text("") == "" and text("<p>") == "" and text("<!-- open") == ""
    assert text("<article><p>never closed <b>text") == "never closed text"
    assert text('<article><p title="a>b">in <a href="x">link</a> out</p>') == "in link out"
    assert text("<article><p>1 < 2 and <unknown>tag</unknown></p></article>").startswith("1 < 2 and")
    assert len(text("<article>" + "<p>word</p>" * 20000 + "</article>").split()) == 20000
    h.blocks("<a title='" * 2000)  # unclosed quotes stay cheap


def test_tree_on_held_out_pages():
    x, y = h.labelled_blocks(h.labelled_pages(120, 77))
    assert ((h.trained().predict(x) >= 0.5) == y).mean() >= 0.97
    assert x.shape[1] == len(h.FEATURES)


def test_tree_splits_on_the_telling_feature():
    x = np.array([[0, 5], [1, 5], [0, 6], [1, 6], [0, 7], [1, 7], [0, 8], [1, 8]], float)
    tree = h.Tree(x, x[:, 0], least=1)
    assert tree.predict(x).tolist() == x[:, 0].tolist() and len(tree.nodes) == 3


def test_extract(spark):
    rows = [(1, "u", f"<body>{ARTICLE}</body>"), (1, "u", f"<body>{ARTICLE}</body>"), (2, None, None), (None, "v", ""),
            (3, "w", "just text without tags that goes on for a while")]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", text string")
    got = sorted(map(tuple, h.extract(df).collect()), key=repr)
    assert len(got) == 5 and all(r[3] == len(r[2]) for r in got)
    assert [r[2] for r in got if r[0] == 1] == ["A & B onetwo three four five x <y> é"] * 2
    assert [r[2] for r in got if r[0] in (2, None)] == ["", ""]
    assert h.extract(spark.createDataFrame([], PAGES)).collect() == []
