"""The contracts' queries against brute force, and the operators on awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import queries as Q
from tessera.llm.graph import connected_components
from tessera.llm.langid import identify_languages
from tessera.llm.lines import dedup_lines, deletion_keys
from tessera.llm.mixing import mix_sources, water_fill
from tessera.llm.packing import Limits, pack_documents
from tessera.llm.quality import quality_verdicts
from tessera.llm.sharding import histogram_sort_shards
from tessera.llm.simhash import BKTree, near_links, simhash, simhash_groups
from tessera.llm.tokens import Counter as TokenCounter
from tessera.llm.tokens import token_counts
from tessera.llm.topk import block_top, exact_top_k, quantised, statistics
from tessera.llm.wordbpe import WordBpe
from tessera.llm.wrappers import Wrapper, _slots, blocks, extract_main_text, infer, main_text

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split_words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (None, "a null id with some words here", "en", None),
        (1, None, None, "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", None),
        (4, "one two three four five six\nshort", "en", "b"),
        (5, "one two three four five six\nshort", "en", "b"),
        (5, "one two three four five six\nshort", "en", "b"),
        (6, "one two three FOUR five six", None, "b"),
        (7, "word " * 30_000, "en", "c"),
        (8, "x" * 60_000, "de", "c"),
        (8, "☃ñ𐍈 <s> <|endoftext|> ﬁ", "de", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, _raw int, tie string, shard int, n int, _q int, h long, key int, fp int"
    return spark.createDataFrame([(*r, 1, "t", 7, 1, 2, 3, 4, 5) for r in rows], schema)


def empty(df):
    return df.where("false")


# --- sharding


def check_shards(rows, n):
    at = defaultdict(list)
    for r in rows:
        at[r.shard].append(r)
    for found in at.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    sizes = [sum(r.size for r in at[i]) for i in range(n)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows) + 0.01 * sum(sizes) / n
    return at


def test_shards_are_contiguous_and_even(spark, docs):
    rows = Q.op1_histogram_sort(spark, SF).collect()
    assert len(rows) == len(docs)
    at = check_shards(rows, 40)
    edges = [(min(r.doc_id for r in at[i]), max(r.doc_id for r in at[i])) for i in sorted(at)]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:], strict=False))
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode()))


def test_shards_cut_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("k"), F.lit(10).alias("size"))
    rows = histogram_sort_shards(df, n_shards=7, key="k", size="size").collect()
    assert len(rows) == 3000
    check_shards(rows, 7)


def test_shards_of_odd_rows(spark, odd):
    sized = odd.withColumn("size", F.octet_length("text")).select("doc_id", "size", "tie", "shard", "_raw")
    out = histogram_sort_shards(sized, n_shards=3, key="doc_id", size="size")
    assert out.count() == sized.count() and set(out.columns) >= {"tie", "_raw", "shard", "slot"}
    assert histogram_sort_shards(empty(sized), n_shards=3, key="doc_id", size="size").count() == 0


# --- token counts


def test_token_counts_match_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in Q.op2_token_counts(spark, SF).collect():
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(library.encode(text[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 4096)


@pytest.mark.parametrize("chunk, overlap", [(700, 8), (64, 2), (16, 1)])
def test_chunks_are_resynchronised(docs, chunk, overlap):
    counter = TokenCounter(PIECES, chunk, overlap)
    texts = [*docs.text[:25], "x" * 500, "你" * 300, "aaaa " * 90, " " * 400, "☃𐍈" * 80, "</s>" * 50, "▁a" * 100]
    assert counter.counts(texts) == [len(counter.library.encode(t)) for t in texts]


def test_token_counts_of_odd_rows(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kept = token_counts(odd.withColumn("copy", F.col("text")), model=PIECES, chunk=1000, overlap=10).collect()
    assert len(kept) == 11
    assert all(r.n_tokens == len(library.encode(r.copy or "")) for r in kept)
    assert token_counts(empty(odd), model=PIECES).count() == 0


# --- SimHash


def brute_simhash(text):
    w = [x.encode() for x in split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_groups_match_brute_force(spark, docs):
    rows = sorted(Q.op3_simhash_groups(spark, SF).collect())
    prints = [brute_simhash(t) for t in docs.sort_values("doc_id").text]
    ids = sorted(docs.doc_id)
    assert [(r.doc_id, r.fingerprint) for r in rows] == [(i, f"{p:016x}") for i, p in zip(ids, prints, strict=True)]
    assert [r.component_id for r in rows] == brute_groups(ids, prints)


@pytest.mark.parametrize("tree_size", [7, 2048])
def test_links_keep_every_connection(spark, tree_size):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for _ in range(260):
        x = prints[rng.integers(len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, tree_size=tree_size)
    found = {r.node: r.component for r in connected_components(links).collect()}
    mask = (1 << 64) - 1
    expected = brute_groups(prints, [p & mask for p in prints])
    assert [found.get(p, p) for p in prints] == expected


def test_components_of_chains_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 1 << 12, 300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (q ^ v).bit_count() <= 2]


def test_simhash_of_odd_rows(spark, odd):
    rows = simhash_groups(odd).collect()
    assert len(rows) == 11
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash(b"") == 0 and simhash_groups(empty(odd)).count() == 0


# --- line dedup


def brute_dropped(rows, min_words=5):
    """Lines that an earlier one equals, or is one word put in, left out or replaced away from, by sets of all such forms."""
    lines = sorted((d, n, tuple(w)) for d, t in rows for n, w in ((n, split_words(x)) for n, x in enumerate(t.split("\n"))) if w)
    gone, whole, shorter, holed = set(), set(), set(), set()
    for d, n, w in lines:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > min_words else set()
        holes = {w[:i] + (None,) + w[i + 1 :] for i in range(len(w))} if len(w) >= min_words else set()
        if w in whole or (len(w) >= min_words and w in shorter) or cut & whole or holes & holed:
            gone.add((d, n))
        whole.add(w)
        shorter |= cut
        holed |= holes
    return gone


def test_line_dedup_matches_brute_force(spark, docs):
    gone = brute_dropped(list(zip(docs.doc_id, docs.text, strict=True)))
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in Q.op4_line_dedup(spark, SF).collect():
        lines = text[r.doc_id].split("\n")
        assert r.text == "\n".join(x for n, x in enumerate(lines) if (r.doc_id, n) not in gone)
        assert (r.n_lines, r.n_dropped) == (len(lines), sum(d == r.doc_id for d, _ in gone))


def test_line_edits(spark):
    base = "alpha beta gamma delta epsilon zeta eta"
    w = base.split()
    texts = [base, " ".join(w[:3] + ["X"] + w[4:]), " ".join(w[:-1]), " ".join(["new", *w]), " ".join(w[:2] + ["a", "b"] + w[4:]), "a b c d", "a b c d"]
    rng = np.random.default_rng(3)
    for _ in range(150):
        x = [str(v) for v in rng.integers(0, 3, rng.integers(5, 9))]
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = brute_dropped(list(enumerate(texts)))
    assert {(1, 0), (2, 0), (3, 0)} <= gone and (4, 0) not in gone
    out = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert {i for i, t in out.items() if t == ""} == {i for i, _ in gone}


def test_a_template_line_with_one_changing_word(spark):
    texts = spark.range(40_000).selectExpr("id as doc_id", "concat('this is page number ', id, ' of the great book') as text", "'x' as `a.b`")
    found = dedup_lines(texts, counts=("lines", "gone"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in found.where("gone = 0").collect()] == [0] and "a.b" in found.columns


def test_deletion_keys_are_those_of_the_shorter_line():
    h = np.random.default_rng(4).integers(0, 1 << 63, 9).astype("uint64")
    keys, whole = deletion_keys(h, 0, 9)
    assert [int(k) for k in keys] == [deletion_keys(np.delete(h, i), 0, 8)[1] for i in range(9)] and whole not in keys


def test_line_dedup_of_odd_rows(spark, odd):
    rows = dedup_lines(odd, counts=("lines", "gone")).collect()
    assert len(rows) == 11 and rows[0]._q == 2
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].text is None and by_id[1].lines == 0 and by_id[2].text == "" and by_id[3].text == " \n\t "
    assert by_id[4].text == "one two three four five six\nshort" and by_id[5].text == "" and by_id[6].text == ""
    assert dedup_lines(odd, drop_emptied=True).count() == 8
    assert dedup_lines(empty(odd)).count() == 0


# --- languages


def test_languages_are_told_apart(spark):
    rows = Q.op5_language_profiles(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    pdf = rows.join(truth, "doc_id").toPandas()
    assert len(pdf) == truth.count() and pdf.score.between(0, 1).all()
    assert (pdf.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in pdf.doc_id]).all()
    held = pdf[pdf.held_out & (pdf.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_languages_of_odd_rows(spark, odd):
    rows = identify_languages(odd, learn_from=F.lit(True)).collect()
    assert len(rows) == 11
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in identify_languages(odd, learn_from=F.lit(False)).collect()} == {"und"}
    assert identify_languages(empty(odd), learn_from=F.lit(True)).count() == 0


# --- pages


def test_pages_give_their_article(spark):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op6_page_text(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", article)))
        expected = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.text == expected and r.n_chars == len(expected)


PAGE = """<html><head><title>t</title></head><body><header><div class="logo">Site</div></header><div class="menu"><a href=x>Home</a></div>
<div class="post"><h2>Title {n}</h2><div>Body {n} of the text &amp; more</div><ul><li>item {n}</li></ul></div>
<div class="promo">Buy now</div><div class="comments"><p>first!</p></div><div>All rights reserved</div><script>var x="<p>no</p>"</script><form>Search</form></body></html>"""


def test_wrapper_tells_template_text_from_slots(spark):
    rows = [(i, "http://h.example/p", PAGE.format(n=i)) for i in range(5)] + [(9, None, None), (10, "nohost", "<p>a <b>b</b><p>c"), (10, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))
    out = {r.page_id: r.text for r in extract_main_text(df).collect() if r.text}
    assert out[3] == "Title 3\n\nBody 3 of the text & more\n\nitem 3"
    assert out[10] == "a b\n\nc"
    assert extract_main_text(empty(df)).count() == 0


def test_wrapper_infers_groups_and_optional_parts():
    card = "<div class=card><h3>t{0}</h3><p>b{0}</p></div>"
    page = lambda cards, note: "<body><div class=top>Same</div>" + "".join(card.format(i) for i in cards) + note + "<div class=end>End</div></body>"
    wrapper = Wrapper()
    for cards, note in (((1,), ""), ((2, 3, 4), "<div class=x><h4>n</h4><p>m</p></div>"), ((5, 6), "")):
        wrapper.align(_slots(list(blocks(page(cards, note)))))
    top, group, extra, end = wrapper.nodes
    assert [len(group.parts), group.plus, group.optional, group.n] == [2, True, False, 3]
    assert [len(extra.parts), extra.plus, extra.optional, extra.n] == [2, False, True, 1]
    assert top.fixed and end.fixed and top.n == end.n == 3 and not any(x.fixed for x in group.parts)


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", "<div class=post><h2>T</h2><p>only text</p></div>") for i in range(6)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"T\n\nonly text"}


def test_wrapper_labels_slots_of_articles(spark):
    page = "<nav>m</nav><article><div>Read more with us</div><h1>Title {0}</h1><p>Text {0} that is long enough, by some words, to fill four fifths of the region and more.</p></article><p>open {0}</p>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)] + [(9, "http://h.example/9", "<p>open 9</p>")]
    # Articles that a host repeats under changing menus are no template.
    rows += [(i, f"http://copies.example/{i}", f"<nav>{i}</nav><article><h1>T</h1><p>only text</p></article>") for i in range(20, 26)]
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # The ninth page lacks the line, so it is no longer on every page.
    assert out[3] == "Read more with us\n\nTitle 3\n\nText 3 that is long enough, by some words, to fill four fifths of the region and more." and out[9] == "open 9"
    assert {out[i] for i in range(20, 26)} == {"T\n\nonly text"}
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows[:6], "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3\n\nText 3 that is long enough, by some words, to fill four fifths of the region and more."


def test_slots_decide_where_names_of_containers_mislead(spark):
    """No article, no telling names; or names that mislead: the texts that change from page to page are the main text."""
    plain = "<div class=a1><a href=x>Home</a> <a href=y>About</a></div><div class=a2><h2>Title {0}</h2><p>Body {0} of some length</p><p>Share this with friends</p></div><p>Copyright by us</p>"
    wide = "<body class='has-sidebar'><form><div class=c><p>Alpha {0} beta gamma</p><p>delta {0}</p></div><div class=sidebar><p>Tip {0}</p></div></form><p>Bye now</p></body>"
    twice = "<div><p>Welcome to the site</p></div><div><p>News {0} of today</p></div>"
    rows = [(100 * k + i, f"http://h{k}.example/{i}", "x" * 0 + page.format(i)) for k, page in enumerate((plain, wide, twice)) for i in range(8)]
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3\n\nBody 3 of some length"
    assert out[203] == "News 3 of today"
    # A sidebar of a few characters a page does not keep the outer containers from holding nearly all varying text.
    assert out[103] == "Alpha 3 beta gamma\n\ndelta 3"
    alone = [main_text(page, Wrapper()) for page in (plain.format(3), wide.format(3), twice.format(3))]
    assert alone[0] != out[3] and alone[1] != out[103] and alone[2] != out[203]


def test_long_pages_are_aligned_whole():
    items = lambda i: "".join(f"<div class=k{n}><p>{i} {n} text</p></div>" for n in range(700))
    wrapper = infer([f"<p>Same</p>{items(i)}<p>End</p>" for i in range(5)])
    text = main_text(f"<p>Same</p>{items(9)}<p>End</p>", wrapper)
    assert text.startswith("9 0 text") and text.endswith("9 699 text")


def test_broken_markup_is_read():
    assert main_text("<article><p>a &lt; b<p>c<nav>x</nav><!-- y <p>z", Wrapper()) == "a < b\n\nc"
    assert main_text("<article><p title='a>b'>x</p><p class=\"ad\n\">y</p", Wrapper()) == "x\n\ny"


# --- mixing


def test_mix_meets_targets(spark, docs):
    rows = Q.op7_source_mix(spark, SF).collect()
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    size = {i: len(split_words(t)) for i, t in text.items()}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    of = Counter()
    for i, n in size.items():
        of[source[i]] += n
    names = sorted(of)
    goals = dict(zip(names, water_fill([of[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], sum(of.values()), 3.0), strict=True))
    assert abs(sum(goals.values()) - sum(of.values())) < 1e-6 * sum(of.values())
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == of[source[r.doc_id]] and r.target == pytest.approx(goals[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goals[s]) <= 1 for s in names)
    assert sorted(rows) == sorted(Q.op7_source_mix(spark, SF).collect())


def test_water_filling():
    targets = water_fill([10, 10, 80], [1, 2, 3], 100, 3)
    assert sum(targets) == pytest.approx(100) and targets[1] == 30 and targets[2] == pytest.approx(3 * targets[0])
    assert water_fill([0, 0], [1, 2], 0, 3) == [0, 0]


def test_mix_of_odd_rows(spark, odd):
    sized = odd.withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), " ")))
    rows = mix_sources(sized).collect()
    assert len(rows) == 11 and rows[0].tie == "t"
    assert mix_sources(empty(sized)).count() == 0


# --- quality


def brute_quality(text):
    w = split_words(text)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark, docs):
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in Q.op8_quality_rules(spark, SF).collect():
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == brute_quality(text[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    pdf = Q.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    good = pdf[(pdf.quality == 1) & ~pdf.base_failed]
    assert good.kept.mean() > 0.99 and pdf[pdf.quality == 0].kept.mean() < 0.1


def test_quality_is_native(spark, docs):
    plan = Q.op8_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_of_odd_rows(spark, odd):
    rows = quality_verdicts(odd).collect()
    assert len(rows) == 11 and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert {r.n_repeat_words for r in rows if r.doc_id == 7} == {30_000}
    assert quality_verdicts(empty(odd)).count() == 0


# --- top-k


def brute_top(vectors, k=5):
    ids = sorted(vectors)
    m = np.array([[int(np.floor(256 * float(x))) for x in vectors[i]] for i in ids])
    scores = m @ m.T
    out = []
    for i, q in enumerate(ids):
        if q % 50 == 0:
            best = sorted((-int(scores[i, j]), c) for j, c in enumerate(ids) if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_top_k_matches_brute_force(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = Q.op9_exact_top_k(spark, SF).collect()
    assert sorted(map(tuple, rows)) == brute_top(vectors)


def test_top_k_in_small_blocks_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)]
    bad = [(300, None), (350, [1.0, None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0] * 8), (500, []), (550, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = exact_top_k(quantised(df), queries=F.col("vec_id") % 50 == 0, query_block=2, candidate_block=37)
    assert sorted(map(tuple, found.collect())) == brute_top(dict(rows))
    few = exact_top_k(quantised(spark.createDataFrame(rows[:3], df.schema)), queries=F.col("vec_id") == 0)
    assert few.count() == 2
    assert exact_top_k(quantised(empty(df)), queries=F.lit(True)).count() == 0


def test_bounds_discard_most_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(15)
    centres = rng.normal(0, 100, (40, 64))
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 10, (2000, 64)))
    ids, asked = np.arange(2000), np.arange(0, 2000, 50)
    who, name, score, scored = block_top(v[asked], asked, statistics(v[asked]), v, ids, statistics(v), 5)
    assert scored < 0.5 * len(asked) * 1999
    expected = brute_top({i: x / 256 for i, x in zip(ids.tolist(), v, strict=True)})
    assert sorted(zip(who.tolist(), name.tolist(), score.tolist(), strict=True)) == sorted((q, c, s) for q, _, c, s in expected)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0**45 + 1, 3.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    found = {(r.query_id, r.vec_id): r.score for r in exact_top_k(quantised(df), queries=F.lit(True)).collect()}
    assert found[0, 1] == most and found[0, 2] == -most and found[3, 4] == 3 * 256 * 256 and found[4, 0] == 65536


# --- packing


def check_packing(rows, ids_of, limits):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids_of)
    for d, found in pieces.items():
        ids, at = ids_of[d], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(found) <= limits.segments
    return sum(len(x) for x in ids_of.values()) / (limits.tokens * len(sequences))


def test_packing_holds_every_id_once(spark, docs):
    library = Tokenizer.from_file(WORDS)
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert check_packing(Q.op10_packing(spark, SF).collect(), ids, Limits()) > 0.98


def test_packing_keeps_all_limits(spark):
    library = Tokenizer.from_file(WORDS)
    texts = ["a b c " * (i % 17) + "x" * (i % 5) for i in range(400)]
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, i % 23) for i, t in enumerate(texts)], "doc_id long, text string, prompt int")
    limits = Limits(tokens=64, segments=5, loss=40, min_cut=4)
    rows = pack_documents(df, tokenizer=WORDS, lossless="prompt", limits=limits, window=50, with_ids=True).collect()
    check_packing(rows, ids, limits)
    loss = Counter()
    for r in rows:
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length]
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, r.doc_id % 23))
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 40


def test_ids_are_the_librarys():
    bpe, library = WordBpe(WORDS, memo=500), Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(6)
    bits = ["ab", "'s", "'", "S", "É", "é", "1", "９", "<|endoftext|>", "<|", "|>", " ", "\n", "́", "\xa0", "ª", "İ", ".,", "#", "\x0b", "×", "÷", "ß", "ẞ", "你"]
    for _ in range(2000):
        text = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 14)))
        assert bpe.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_odd_rows(spark, odd):
    rows = pack_documents(odd, tokenizer=WORDS).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 1] == [(1, 1)]
    assert pack_documents(empty(odd), tokenizer=WORDS).count() == 0
