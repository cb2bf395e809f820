"""Mixing, URL rules and quality rules, against SQL and by hand."""

import random

import pytest

from pyspark.sql import functions as F

from duskrank.llm import line_quality, mixing, url_rules


@pytest.fixture(scope="module")
def sql(edge_docs):
    import duckdb

    def run(text, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toPandas().astype({"doc_id": "Int64"} if "doc_id" in df.columns else {}))
        return sorted(con.execute(text).fetchall(), key=str)

    return run


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_targets_are_filled_by_weight(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 300), (None, 50), ("d", 0)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    caps, left, target, open_ = {s: 2 * n for s, n in sizes}, 1.5 * 1450, {}, set(weights)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > caps[s]}
        for s in over or open_:
            target[s] = caps[s] if over else share[s]
            left -= target[s]
        open_ -= over or set(open_)
    for s, want in target.items():
        assert got[s]["target"] == pytest.approx(want), s


def test_taken_words_meet_the_targets(make_docs, prose):
    rng = random.Random(3)
    docs = make_docs([(i, prose(i, rng.randint(0, 9)), rng.choice(["a", "a", "a", "b", None])) for i in range(300)])
    got = mixing.mix(docs, slice_rows=16).collect()
    again = mixing.mix(docs.repartition(7), slice_rows=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # neither slices nor partitions matter
    for source in {r["source"] for r in got}:
        part = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in part) == int(part[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in part)


def test_mix_edge_rows(edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.repeated(edge_docs, mixing.mix(edge_docs)).columns == edge_docs.columns
    assert mixing.repeated(no_docs, mixing.mix(no_docs)).count() == 0


def test_url_edge_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "x://EXAMPLE.org/es", "x://example.org/en/17",
        "x://notexample.org/es/", "x://org?q", "x://a.com/fr/", "x://a.com/de/1#z", "x://a.b.com:80/de/", "s://spam.net/x",
        "s://a.net/cheap-pills/1", "s://a.net/cheap-pillsx", "a://b.net/c://d.com/fr/", "s://spam.net/x",
    ]
    pages = spark.createDataFrame([(i, u, "<p>", "c") for i, u in enumerate(urls)], "page_id long, url string, html string, name string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.filter_pages(pages).collect()}
    assert len(got) == len(urls)
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow", None)
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block", None)
    assert got[5] == ("example.org", "/es", "org/", "allow", None)
    assert got[6][2:4] == ("example.org/en/1", "block")
    assert got[7][2:4] == ("org/", "allow")
    assert got[8] == ("org", "", None, "allow", None)
    assert got[9][2:4] == ("com/fr/", "allow") and got[10][2:4] == ("com/de/", "block")
    assert got[11] == ("a.b.com:80", "/de/", None, "allow", None)
    assert got[12][2:] == (None, "block", "spam") and got[16] == got[12]
    assert got[13][2:] == (None, "block", "cheap-pills") and got[14][2:] == (None, "allow", None)
    assert got[15][:2] == ("b.net", "/c://d.com/fr/")
    assert url_rules.filter_pages(pages.limit(0)).count() == 0


def test_url_rules_need_a_literal(spark):
    with pytest.raises(ValueError):
        url_rules.rule_table(spark, [url_rules.Rule("x", ".*", (), "block", 0)])


def test_quality_equals_sql_on_edge_rows(edge_docs, sql):
    got = line_quality.judge(edge_docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows(got.select(names)) == sql(line_quality.SQL, documents=edge_docs.select("doc_id", "text", "source"))


def test_boilerplate_goes_and_depleted_documents_go(make_docs, prose, sentence):
    line = sentence("boiler", 12)
    own = [(i, prose(i) + "\n" + line, "a") for i in range(30)]
    shell = [(100, "\n".join([line] * 4), "a"), (101, line + "\n" + line.upper(), "a")]
    copies = [(200 + i, prose("copied"), "a") for i in range(40)]
    near = [(300 + i, prose("near") + "\nlast " + sentence(i), "a") for i in range(40)]
    other_host = [(500, "\n".join([sentence(f"z{k}", 9) for k in range(3)] + [line]), "b")]
    docs = make_docs(own + shell + copies + near + other_host)
    kept = {r["doc_id"]: r["kept"] for r in line_quality.judge(docs).collect()}
    assert not kept[100] and not kept[101]
    assert all(v for i, v in kept.items() if i not in (100, 101))
    out = {r["doc_id"]: r for r in line_quality.apply(docs).collect()}
    assert set(out) == {i for i, v in kept.items() if v}
    assert all(line not in out[i]["text"] for i in range(30)) and line in out[500]["text"]
    assert all(out[i]["n_chars"] == len(out[i]["text"]) for i in out)
    assert out[200]["text"] == prose("copied") and out[300]["text"].startswith(prose("near"))


def menu_pages(make_docs, sentence):
    """1,000 pages with 40 words of menu and 60 of their own, a page that is only menu, 300 near copies of an article."""
    menu = [sentence(f"menu{k}", 8) for k in range(5)]
    rows = [(i, "\n".join(menu + [sentence(f"own{i}-{k}", 12) for k in range(5)]), "a") for i in range(1000)]
    rows.append((1000, "\n".join(menu), "a"))
    article = [sentence(f"article{k}", 14) for k in range(12)]
    for i in range(300):
        copy = list(article)
        words = copy[i % 12].split(" ")
        words[i % 14] = f"edit{i}"
        copy[i % 12] = " ".join(words)
        rows.append((2000 + i, "\n".join(copy), "a"))
    return make_docs(rows), menu, article


def test_menus_go_and_copies_stay(make_docs, sentence, sql):
    docs, menu, article = menu_pages(make_docs, sentence)
    kept = {r["doc_id"]: r["kept"] for r in line_quality.judge(docs).collect()}
    assert {i for i, k in kept.items() if not k} == {1000}
    out = {r["doc_id"]: r["text"] for r in line_quality.apply(docs).collect()}
    assert 1000 not in out and all(not set(menu) & set(out[i].split("\n")) for i in range(1000))
    assert all(len(set(article) & set(out[2000 + i].split("\n"))) == 11 for i in range(300))
    names = ["doc_id", "n_words", "kept"]
    want = sql(f"SELECT doc_id, n_words, kept FROM ({line_quality.SQL})", documents=docs.select("doc_id", "text", "source"))
    assert rows(line_quality.judge(docs).select(names)) == want


def test_rows_that_share_an_id_share_out_the_copies(make_docs, sentence):
    docs = make_docs([(None, sentence(f"{i}", 10), "a") for i in range(3000)] + [(7, "b c", "b"), (7, "b c", "b")])
    for slice_rows in (50, 1 << 16):
        mixed = mixing.mix(docs.repartition(5), slice_rows=slice_rows, budget=0.95)
        taken = dict(mixed.groupBy("source").agg(F.sum("taken")).collect())
        out = mixing.repeated(docs, mixed)
        got = dict(out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text")))).collect())
        assert taken.keys() >= got.keys() and all(abs(taken[s] - got.get(s, 0)) <= 10 for s in taken)
        assert out.filter("source = 'a'").groupBy("text").count().agg(F.max("count")).first()[0] <= 2


def test_quality_of_no_documents(no_docs):
    assert line_quality.judge(no_docs).count() == 0 and line_quality.apply(no_docs).columns == no_docs.columns


def test_repeated_windows_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        ws = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
        assert line_quality.repeated_window_words(ws) == len(marked)


def test_line_hash_is_the_engine_hash(spark):
    got = spark.sql("select xxhash64('hällo wörld, long enough to fill a whole stripe of the hash')").first()[0]
    assert got == line_quality.line_hash("hällo wörld, long enough to fill a whole stripe of the hash".encode())
