"""Pages whose containers have telling names: nothing that reads as text is lost, and what lies beside it stays out."""

import pytest

from tessera.llm.wrappers import Node, Wrapper, blocks, extract_main_text, fold, infer, main_text

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def words(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] for i in range(n)) + f" {seed}."


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return {r.page_id: r.text for r in extract_main_text(df).collect()}


def test_a_drawing_that_closes_itself_ends_there(spark):
    found = texts(spark, ['<article><p>t0</p><svg class="i"/><p>second</p></article>', '<article><p>a</p><svg viewBox="0 0 1 1"><path d="M0"/></svg><p>b</p></article>', "<article><p>a</p><iframe src='x'><p>b</p></article>", "<p>a</p><script>var x = '<p>b</p>'"])
    assert found == {0: "t0\n\nsecond", 1: "a\n\nb", 2: "a\n\nb", 3: "a"}


def test_an_article_whose_class_names_a_side_region(spark):
    def page(i, name):
        return f'<nav><a href="/">Home page</a></nav><article class="{name}"><h1>{words(i, 4)}</h1><p>{words(i + 50, 40)}</p><p>{words(i + 90, 30)}</p></article><div class="comments"><p>{words(i + 130, 8)}</p></div>'

    for name in ("post social", "newsletter", "comments"):
        found = texts(spark, [page(i, name) for i in range(8)])
        assert found == {i: f"{words(i, 4)}\n\n{words(i + 50, 40)}\n\n{words(i + 90, 30)}" for i in range(8)}, name
    assert main_text(page(3, "newsletter"), Wrapper()).endswith(f"{words(53, 40)}\n\n{words(93, 30)}")


def test_vague_names_inside_an_article(spark):
    def page(i):
        return (
            f'<article><h1>{words(i, 4)}</h1><p>{words(i + 20, 30)}</p><section class="share-price"><p>{words(i + 60, 25)}</p></section>'
            f'<div class="share"><a href="#">Share this on a network</a> <a href="#">Or on another network</a></div><div class="notice">The same notice stands on every page of this host.</div></article>'
        )

    found = texts(spark, [page(i) for i in range(8)])
    assert found == {i: f"{words(i, 4)}\n\n{words(i + 20, 30)}\n\n{words(i + 60, 25)}" for i in range(8)}
    one = f'<main><p>{words(1, 20)}</p><div class="related-work"><p>{words(2, 30)}</p></div><div class="share">Share</div></main>'
    assert main_text(one, Wrapper()) == f"{words(1, 20)}\n\n{words(2, 30)}"


def test_pages_without_a_main_element_beside_hosts_with_one(spark):
    bare = [f'<div class="top-bar">Site name here</div><div id="c"><p>{words(i, 30)}</p><p><a href="/{i}">{words(i + 40, 6)}</a></p><p>{words(i + 80, 30)}</p></div><div class="sidebar"><p>{words(i + 120, 9)}</p></div><footer>All rights kept.</footer>' for i in range(9)]
    assert main_text(bare[0], Wrapper()) == f"{words(0, 30)}\n\n{words(40, 6)}\n\n{words(80, 30)}"
    df = spark.createDataFrame([(i, None if i % 2 else "not an address", p) for i, p in enumerate(bare)], "page_id int, url string, html string")
    for r in extract_main_text(df).collect():
        assert words(r.page_id, 30) in r.text and words(r.page_id + 80, 30) in r.text and "rights" not in r.text and words(r.page_id + 120, 9) not in r.text


def test_a_wrapper_learns_what_names_do_not_tell():
    """A template text in a plain container, which only the other pages give away."""
    pages = [f"<div class='x'><p>Read the terms of this fine host before you go on.</p></div><div class='y'><p>{words(i, 30)}</p></div>" for i in range(6)]
    wrapper = infer(pages)
    assert main_text(pages[0], wrapper) == words(0, 30) != main_text(pages[0], Wrapper())


@pytest.mark.parametrize("n", [2, 13, 40])
def test_groups_of_any_length_are_folded(n):
    row = [Node(("div", f"p{i}")) for i in range(n)]
    nodes = fold([Node(x.path) for _ in range(5) for x in row])
    assert len(nodes) == 1 and len(nodes[0].parts) == n and nodes[0].plus
    table = "".join("<tr>" + "".join(f"<td>{r}.{c}</td>" for c in range(n)) + "</tr>" for r in range(30))
    assert len(list(blocks(f"<table>{table}</table>"))) == 30 * n
    assert main_text(f"<article><table>{table}</table></article>", infer([f"<article><table>{table}</table></article>"] * 2)).count("\n\n") == 30 * n - 1


def test_names_in_any_case(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>one two</p>", "x")], "page_id int, url string, html string, TEXT string")
    out = extract_main_text(df)
    assert sorted(out.columns) == ["page_id", "text", "url"] and out.select("text").first().text == "one two"
