"""Stages and passages: which rows and words stay, whatever ids, columns and copies a table has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import html_extract, neardup, packing
from auditloom.llm.common import scratch_root
from auditloom.llm.decontamination import drop_contaminated
from auditloom.llm.exact_dedup import drop_exact_duplicates
from auditloom.llm.language_id import keep_identified
from auditloom.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from auditloom.llm.queries import vocabulary
from auditloom.llm.substring_dedup import remove_repeated, repeated_paragraphs

from .test_llm import brute_components, words_of

#: Column names that the operators use inside.
CLASHES = "__id __raw __salt __key raw group row rank gone first size id of comp held doc h uid n sig label a b key hub times stays place".split()


def clashing(spark, rows):
    """Rows of (doc_id, text, note) with every clashing name as a column."""
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, note int")
    return df.select("doc_id", "text", "note", *[F.lit(f"own {c}").alias(c) for c in CLASHES]).repartition(3)


RNG = np.random.default_rng(21)
BASE = words_of(RNG, 120, 1 << 30)
NEAR = " ".join(["changed", *BASE.split()[1:]])
OTHER = [words_of(RNG, 80, 1 << 30) for _ in range(4)]


def left(df, columns):
    rows = df.collect()
    assert df.columns == columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    rows = [(1, BASE), (2, NEAR), (2, OTHER[0]), (2, OTHER[1]), (None, NEAR + " more"), (None, OTHER[2]), (3, None), (3, ""), (4, OTHER[3]), (4, OTHER[3])]
    df = clashing(spark, rows)
    plain = sorted([(1, BASE), (2, OTHER[0]), (2, OTHER[1]), (None, OTHER[2]), (3, None), (3, ""), (4, OTHER[3])], key=str)
    assert left(drop_near_duplicates(df), df.columns) == plain
    exact = sorted([x for x in dict.fromkeys(rows) if x != (3, "")], key=str)
    got = left(drop_exact_duplicates(df), df.columns)
    assert [x for x in got if x[0] != 3] == [x for x in exact if x[0] != 3] and len([x for x in got if x[0] == 3]) == 1
    bench = spark.createDataFrame([(7, " ".join(NEAR.split()[:10]))], "item_id long, text string")
    assert left(drop_contaminated(df, bench), df.columns) == sorted([x for x in rows if not (x[1] or "").startswith("changed")], key=str)


def test_copies_without_id_leave_one(spark):
    df = clashing(spark, [(None, BASE)] * 5 + [(None, NEAR)] * 2 + [(None, OTHER[0])])
    assert left(drop_exact_duplicates(df), df.columns) == sorted([(None, BASE), (None, NEAR), (None, OTHER[0])], key=str)
    assert len(left(drop_near_duplicates(df), df.columns)) == 2


def test_unidentified_rows_go_and_no_others(spark):
    rows = [(i, f"the quick brown fox and that thing {i}") for i in range(30)] + [(1, "12 34"), (None, "!!"), (None, "the fox and the hound"), (5, None)]
    df = clashing(spark, rows).withColumn("lang", F.lit("en"))
    got = sorted(((r.doc_id, r.text) for r in keep_identified(df, vocabulary("piece_bpe_32k.model")).collect()), key=str)
    assert got == sorted([x for x in rows if x[1] and "the" in x[1]], key=str)


def test_stages_of_empty_tables(spark):
    df = clashing(spark, [(1, "a")]).withColumn("lang", F.lit("en")).limit(0)
    bench = spark.createDataFrame([(7, "x y z")], "item_id long, text string")
    for out in (drop_near_duplicates(df), drop_exact_duplicates(df), drop_contaminated(df, bench), keep_identified(df, vocabulary("piece_bpe_32k.model")), remove_repeated(df), repeated_paragraphs(df)):
        assert out.count() == 0


def test_no_scratch_folder_is_made_up_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Spark:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError):
        scratch_root(Spark)


@pytest.mark.parametrize("block", [None, 4])
def test_hubs_of_any_size_lose_no_link(spark, monkeypatch, block):
    """Documents of one template share hubs without being similar; families of near copies among them must be found."""
    if block:
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "SPLIT", block)
    rng = np.random.default_rng(13)
    template = words_of(rng, 60, 1 << 30)
    rows = []
    for _ in range(40):
        body = words_of(rng, 60, 1 << 30).split()
        for k in range(int(rng.integers(1, 4))):
            rows.append((len(rows), template + " " + " ".join([*body[:50], *(f"x{rng.integers(1 << 30)}" for _ in range(k)), *body[50:]])))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()}
    assert [got[i] for i in range(len(rows))] == brute_components(rows, 80)


def sentences(rng, n):
    return [words_of(rng, int(rng.integers(10, 16)), 1 << 30) for _ in range(n)]


def test_no_word_leaves_the_corpus(spark):
    """Sentences and passages put together at random, lines with near copies: every ordinary word stays somewhere."""
    rng = np.random.default_rng(31)
    pool, passages = sentences(rng, 25), [words_of(rng, 60, 1 << 30) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 5))):
            some = [pool[j] for j in rng.integers(0, len(pool), int(rng.integers(1, 5)))]
            if rng.random() < 0.4:  # a word of the line is changed, so it may be a near copy of another
                at = int(rng.integers(0, len(some)))
                w = some[at].split()
                w[int(rng.integers(0, len(w)))] = f"changed{rng.integers(1 << 30)}"
                some[at] = " ".join(w)
            lines.append(". ".join(some) + ".")
        if rng.random() < 0.4:
            lines[-1] += " " + passages[int(rng.integers(0, 4))]
        docs.append((i // 2 if i % 7 else None, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    plain = lambda t: {w.rstrip(".") for w in t.split()}
    before = set().union(*(plain(t) for _, t in docs))
    rows = remove_repeated(df).collect()
    after = set().union(*(plain(r.text) for r in rows))
    assert len(rows) == len(docs) and {w for w in before - after if not w.startswith("changed")} == set()
    assert sum(len(r.text) for r in rows) < sum(len(t) for _, t in docs) / 2


def test_repeats_are_cut_where_they_were_found(spark):
    passage = words_of(np.random.default_rng(3), 60, 1 << 30)
    rows = [(1, passage), (2, "other beginning here\n" + passage), (2, "nothing of the kind is in this text, which has the same id as another"), (2, None), (None, passage + "\ntail")]
    got = remove_repeated(clashing(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, passage), (2, "other beginning here"), rows[2], (2, None), (None, "tail")], key=str)
    short = [(1, "Contents\none"), (2, "Contents\ntwo"), (3, "three")]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert repeated_paragraphs(df).count() == 0
    assert {r.doc_id: r.text for r in remove_repeated(df, 1).collect()} == {1: "Contents\none", 2: "two", 3: "three"}


def test_recall_of_line_links_against_brute_force(spark):
    rng = np.random.default_rng(17)
    lines = []
    for _ in range(15):
        base = words_of(rng, 40, 1 << 30).split()
        for k in range(4):
            w = list(base)
            for at in rng.choice(40, k, replace=False):
                w[at] = f"x{rng.integers(1 << 30)}"
            lines.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(lines)]
    want = brute_components(rows, 80)
    several = {c for c in want if want.count(c) > 1}
    got = {r.doc_id: (r.keep_doc_id, r.removed) for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'line'").collect()}
    assert got == {i: (c, c != i) for i, c in enumerate(want) if c in several}


def naive(node, root):
    """(chars, tags, link chars, link tags) by recursion."""
    c = t = lc = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += len("".join(x.split()))
        else:
            a, b, d, e = naive(x, root)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
    return (c, t, c, t) if node.tag == "a" else (c, t, lc, lt)


def density(node, root):
    c, t, lc, lt = naive(node, root)
    whole = naive(root, root)
    if not c:
        return 0.0
    one = lambda x: max(x, 1)
    base = np.log(c * lc / one(c - lc) + whole[2] / one(whole[0]) * c + np.e)
    inner = c / one(lc) * one(t) / one(lt)
    return c / one(t) * (np.log(inner) / np.log(max(base, 1.0001)) if inner > 1 else 0.0)


def test_density_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        page, depth = [], []
        for _ in range(40):
            if depth and rng.random() < 0.4:
                page.append(f"</{depth.pop()}>")
            else:
                depth.append(str(rng.choice(["div", "section", "a", "span", "ul"])))
                page.append(f"<{depth[-1]}>")
            page.append(" ".join(["word"] * int(rng.integers(0, 9))))
        root = html_extract.parse("".join(page))
        html_extract.prune(root)
        nodes = html_extract.measure(root)
        for n in nodes:
            assert n.density == pytest.approx(density(n, root))
            assert n.score == pytest.approx(sum(density(x, root) for x in n.children if not isinstance(x, str)))
        best = max(nodes, key=lambda n: n.score)
        assert best.score == max(n.score for n in nodes) and any(best is x or any(a is best for a in ancestors(x)) or any(a is x for a in ancestors(best)) for x in html_extract.select(root))


def ancestors(node):
    while node.parent is not None:
        node = node.parent
        yield node


PROSE = "This is a paragraph of the article with a good number of plain words, as articles have them, one after the other."


@pytest.mark.parametrize("wrapper", ["div class=has-sidebar", 'div class="page-with-sidebar"', 'div class="layout banner-top"', 'section class="social-history"', 'section id="related-work"', 'div class="post comments-open"', "form id=aspnet", "main"])
def test_wrappers_with_misleading_names(wrapper):
    tag = wrapper.split()[0]
    text = " ".join([PROSE] * 3)
    page = f"<body><nav><a href=x>menu</a></nav><{wrapper}><article><h1>Title</h1>{''.join(f'<p>{PROSE}</p>' for _ in range(3))}</article></{tag}><footer>f</footer></body>"
    assert html_extract.main_text(page) == f"Title {text}"
    inside = f"<body><ul><li><a href=x>l</a><li><a href=x>m</a></ul><{wrapper}>{''.join(f'<p>{PROSE}</p>' for _ in range(3))}</{tag}><div class=ad>Buy</div></body>"
    assert html_extract.main_text(inside) == text


def test_pages_without_article_and_in_sections():
    section = lambda k: f"<section><h2>Part {k}</h2>" + f"<p>{PROSE}</p>" * 3 + "</section>"
    want = " ".join(f"Part {k} " + " ".join([PROSE] * 3) for k in range(3))
    links = "<ul>" + "".join(f"<li><a href=/{k}>Link number {k}</a>" for k in range(12)) + "</ul>"
    assert html_extract.main_text(f"<div id=x>{links}</div><article><h1>T</h1>{''.join(map(section, range(3)))}</article>") == f"T {want}"
    assert html_extract.main_text(f"<main>{links}<article><h1>T</h1>{''.join(map(section, range(3)))}</article></main>") == f"T {want}"
    assert html_extract.main_text(f"<div id=x>{links}</div><div id=y>{''.join(map(section, range(3)))}</div><div class=cookie-notice>We use cookies</div>") == want
    comments = "<section id=comments>" + "".join(f"<p>Reader {k} says: {PROSE}</p>" for k in range(20)) + "</section>"
    assert html_extract.main_text(f"<main><article><h1>T</h1><p>{PROSE}</p></article>{comments}</main>") == f"T {PROSE}"


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        assert html_extract.main_text("<ul><li>" + "<div>" * n + "<li>z" * n + "<p>deep").endswith("deep")
        return time.process_time() - began

    took(2000)
    assert took(40_000) < 40 * max(took(4_000), 0.02)


def test_plan_cuts_fewer_pieces_than_plain_concatenation(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, words_of(rng, int(rng.integers(20, 150)))) for i in range(3000)], "doc_id long, text string").repartition(4)
    got = packing.pack(df, vocabulary("word_bpe_49k.json")).collect()
    pieces = sum(-(-n // packing.SEQUENCE) for n in {r.doc_id: r.doc_tokens for r in got}.values())
    sequences = len({r.sequence_id for r in got})
    cut = len(got) - pieces
    assert cut < sequences / 3  # laid end to end, nearly each sequence's end cuts a piece


@pytest.mark.parametrize("width,pairs,cost", [(1 << 15, 1 << 22, 256), (64, 7, 256), (64, 50, 0), (3, 1, 2), (64, 50, 10**9)])
def test_intersections_by_pairs_and_by_bit_rows(monkeypatch, width, pairs, cost):
    monkeypatch.setattr(neardup, "PAIR_COST", cost)
    r = np.random.default_rng(5)
    for case in range(40):
        n, top = int(r.integers(0, 25)), (5, 40, 3000)[case % 3]
        bodies = [np.unique(r.integers(0, top, int(r.integers(1, 60))).astype(np.uint64)) for _ in range(n)]
        order, cut = r.permutation(n), int(r.integers(0, n + 1))
        queries, targets = np.sort(order[:cut]), np.sort(order[cut:])
        brute = np.array([[len(np.intersect1d(bodies[i], bodies[j])) for j in targets] for i in queries], np.int64).reshape(len(queries), len(targets))
        assert (neardup._intersections(bodies, queries, targets, width, pairs) == brute).all()


def test_few_gone_rows_do_not_shuffle_the_documents(spark):
    from auditloom.llm.common import drop_rows

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "doc_id long, text string")
    many = spark.range(1 << 22).selectExpr("if(id = 7, null, id) AS doc_id", "xxhash64(if(id = 1, 'a', if(id = 7, 'c', 'z'))) AS raw")  # Spark can't tell how few of them pass
    out = drop_rows(docs, many.where("doc_id = 1 OR doc_id IS NULL"))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.text for r in out.collect()) == ["b", "d"]
