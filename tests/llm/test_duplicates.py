"""Line dedup and near-duplicates against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from duskrank.llm import components, line_chunks, probminhash


def exact(a: str, b: str) -> float:
    """Probability Jaccard from its definition."""

    def weights(text):
        ws = text.split()
        return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()

    x, y = weights(a), weights(b)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x & y)


@pytest.fixture(scope="module")
def corpus(prose, words):
    """Groups of copies with growing edits, texts with repeated shingles, short texts."""
    rng, texts = random.Random(9), []
    for g in range(12):
        base = prose(f"g{g}", 12).split(" ")
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join([prose("r", 3)] * k) for k in (1, 2, 3)]
    texts += ["a b c", "a b c", "a  b\nc", "a b d", "", "", " ", "x"]
    return texts


def classes(links, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_similarity_is_the_definition(corpus):
    rng = random.Random(4)
    for _ in range(100):
        a, b = rng.choice(corpus), rng.choice(corpus)
        got = probminhash.probability_jaccard(probminhash.shingles(a), probminhash.shingles(b))
        assert got == pytest.approx(exact(a, b))


def test_signatures_estimate_weighted_similarity():
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        base = rng.integers(1, 1 << 62, size=120, dtype=np.uint64)
        a, b = np.repeat(base, rng.integers(1, 6, 120)), np.repeat(base, rng.integers(1, 6, 120))
        sig = probminhash.signatures([a, b])
        errors.append((sig[0] == sig[1]).mean() - probminhash.probability_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signature_does_not_depend_on_the_batch():
    texts = [np.arange(1, n, dtype=np.uint64) for n in (2, 7, 900)]
    together = probminhash.signatures(texts)
    for k, t in enumerate(texts):
        assert (probminhash.signatures([t])[0] == together[k]).all()
    assert probminhash.signatures([]).shape == (0, probminhash.COMPONENTS)


def test_classes_equal_brute_force(make_docs, corpus):
    docs = make_docs([(i, t, "a") for i, t in enumerate(corpus)])
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()}
    links = [
        (i, j)
        for (i, a), (j, b) in combinations(enumerate(corpus), 2)
        if a == b or (a.split() and b.split() and exact(a, b) >= 0.8)
    ]
    assert [got[i] for i in range(len(corpus))] == classes(links, len(corpus))
    kept = sorted(r["doc_id"] for r in probminhash.keep_first(docs).collect())
    assert kept == sorted(set(got.values()))


def test_members_beyond_the_pivot_are_compared(make_docs, words):
    """A chain of copies, each similar to the next only, and strangers that share many shingles."""
    text = words[:400]
    chain = [" ".join(text[: 40 * 0] + text[6 * k : 6 * k + 120]) for k in range(12)]
    docs = make_docs([(i, t, "a") for i, t in enumerate(chain)])
    assert {r["class_id"] for r in probminhash.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("edits", [2, 5])
def test_near_copies_below_the_threshold_cost_no_pairs(make_docs, words, edits):
    """300 copies of a text, some linked and some too far from all others: classes by brute force, few pairs compared."""
    rng, texts = random.Random(edits), []
    for k in range(300):
        copy = words[:200]
        for place in rng.sample(range(200), edits if k % 10 else 14):
            copy[place] = f"own{k}x{place}"
        texts.append(" ".join(copy))
    shingled = [probminhash.shingles(t) for t in texts]
    links = [
        (i, j) for i, j in combinations(range(300), 2) if probminhash.probability_jaccard(shingled[i], shingled[j]) >= 0.8
    ]
    search = probminhash.NearDuplicates(make_docs([(i, t, "a") for i, t in enumerate(texts)]))
    asked, verify = [], search._links
    search._links = lambda pairs: asked.append(pairs.count()) or verify(pairs)
    got = {r["doc_id"]: r["class_id"] for r in search.classes().collect()}
    assert [got[i] for i in range(300)] == classes(links, 300)
    first, *later = asked
    assert sum(later) < 300 * 20  # of 44,850


def test_prefix_bound_holds_for_weighted_shingles():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = rng.integers(1, 1 << 62, size=30, dtype=np.uint64)
        a, b = (np.repeat(base[rng.random(30) < 0.9], 1 + rng.integers(0, 3)) for _ in range(2))
        a = np.concatenate([a, np.repeat(base[:5], rng.integers(1, 4))])
        u, w = 1 - np.isin(a, b).mean(), 1 - np.isin(b, a).mean()
        assert probminhash.probability_jaccard(a, b) <= 1 / (1 + u / (1 - u) + w / (1 - w)) + 1e-9


def test_near_duplicate_edge_rows(edge_docs, no_docs):
    got = probminhash.near_duplicates(edge_docs)
    assert got.count() == edge_docs.count()
    kept = probminhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == edge_docs.count() - 1 and texts.count(None) == 2
    assert probminhash.near_duplicates(no_docs).count() == 0 and probminhash.keep_first(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(6)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 700)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(7, 7)]
    links = path + star + loose
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    want = classes(links, 1100)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    groups = {}
    for node, name in got.items():
        groups.setdefault(name, set()).add(want[node])
    assert all(len(g) == 1 and want[name] in g for name, g in groups.items())
    assert len(groups) == len({want[n] for n in got})
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passage_goes_from_all_but_the_first(make_docs, prose, sentence):
    passage = " ".join(sentence(f"p{k}", 9) for k in range(9))
    inline = [(i, f"{prose(i, 6)} {sentence(i, 5)[:-1]} {passage} {prose(-i - 1, 6)}", "a") for i in range(20)]
    lines = [(100 + i, f"{prose(i + 50, 6)}\n{passage}\n{prose(i + 90, 6)}", "a") for i in range(20)]
    clean = [(200 + i, prose(i + 300, 12), "b") for i in range(20)]
    docs = make_docs(inline + lines + clean)
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(docs, "gone").collect()}
    first = min(i for i, *_ in inline + lines)
    assert got[first]["gone"] == 0
    tail = passage.split(". ", 1)[1]  # the first sentence of an inline passage is one line with what precedes it
    for i, text, _ in inline[1:] + lines:
        assert got[i]["gone"] >= 8 and tail[:40] not in got[i]["text"] and tail[-40:] not in got[i]["text"]
        assert got[i]["text"].split()[:30] == text.split()[:30] and got[i]["text"].split()[-30:] == text.split()[-30:]
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert all(got[i]["text"] == t for i, t, _ in clean)


def test_short_passages_of_few_lines_are_all_found(make_docs, words):
    """Passages of 16 to 80 words in 2 to 6 lines, of which both documents hold nothing else in common."""
    rng, rows, passages = random.Random(8), [], {}

    def line(n):
        return " ".join(rng.choices(words, k=n)) + f" {rng.random()}."

    for g in range(120):
        n_lines, n_words = 2 + g % 5, rng.choice((16, 30, 51, 66, 80))
        ends = [0, *sorted(rng.sample(range(1, n_words), n_lines - 1)), n_words]
        passage = [line(b - a - 1) if b - a > 1 else f"w{rng.random()}." for a, b in zip(ends, ends[1:])]
        passages[2 * g + 1] = passage
        for i in (2 * g, 2 * g + 1):
            around = [line(rng.randint(3, 14)) for _ in range(8)]
            rows.append((i, "\n".join(around[: 2 + i % 5] + passage + around[2 + i % 5 :]), "a"))
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(make_docs(rows), "gone").collect()}
    for i, passage in passages.items():
        assert got[i - 1]["gone"] == 0 and got[i]["gone"] == len(passage)
        assert not any(x in got[i]["text"].split("\n") for x in passage)


def test_passages_equal_brute_force(make_docs):
    """Lines of few kinds: those go that lie in a run of enough lines and words with an earlier place."""
    rng = random.Random(3)
    kinds = [" ".join([f"k{k}"] * rng.choice((1, 2, 6, 9, 17))) for k in range(12)]
    docs = [[rng.choice(kinds) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    known, want = set(), []
    for doc in docs:
        gone = set()
        for b in range(len(doc) + 1):
            for a in range(b - 1):
                if sum(len(x.split()) for x in doc[a:b]) >= line_chunks.MIN_WORDS:
                    if tuple(doc[a:b]) in known:
                        gone |= set(range(a, b))
                    known.add(tuple(doc[a:b]))
        want.append(len(gone))
    rows = [(i, "\n".join(doc), "a") for i, doc in enumerate(docs)]
    got = {r["doc_id"]: r["gone"] for r in line_chunks.dedup_lines(make_docs(rows), "gone").collect()}
    assert [got[i] for i in range(len(docs))] == want and sum(want)


def test_every_line_stays_somewhere(make_docs, prose):
    texts = [prose(i % 5, 9) + ("\n" + prose(i, 4)) * (i % 3) for i in range(40)]
    got = line_chunks.dedup_lines(make_docs([(i, t, "a") for i, t in enumerate(texts)])).collect()
    left = "\0".join(r["text"] for r in got)
    assert all(line.strip() in left for t in texts for line in line_chunks.lines_of(t))
    assert len(left) < 0.7 * sum(map(len, texts))


def test_equal_hashes_of_other_lines_stay():
    assert line_chunks.repeated_runs("A b. C d.\nE f.", "X y. Z w.\nE f.", False, [(0, 0, 2)]) == []
    assert line_chunks.repeated_runs("A b. C d.\nE f.", "E g.\nA b. C d.", False, [(0, 1, 2)]) == [(0, 2)]
    assert line_chunks.repeated_runs("A. A. A. A. A. A.", "", True, [(2, 0, 2)]) == [(2, 6)]


def test_equal_lines_in_any_number_are_passed_once():
    text = "Ab cd ef gh ij kl mn op qr.\n" * 20_000
    found = [(int(pos), 0, int(n)) for _, pos, n in zip(*line_chunks.seeds(text), strict=True) if pos]
    assert line_chunks.repeated_runs(text, "", True, found) == [(1, 20_000)]


def test_line_dedup_edge_rows(edge_docs, no_docs):
    out = line_chunks.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.schema == edge_docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, edge_docs.collect()))
    assert line_chunks.dedup_lines(no_docs).count() == 0


def test_lines_make_up_the_text():
    for text in ("", "\n\n", " a. b! c?\n\n d...e. \t\nf", "no end", "x.\n", "\n x"):
        assert "".join(line_chunks.lines_of(text)) == text


def test_chunks_of_many_texts_are_those_of_each():
    rng = random.Random(4)
    texts = ["".join(rng.choices("a.!?      \n\t\0\x1c\u00a0\u3000é東", k=rng.randint(0, 300))) for _ in range(300)] + ["", "\n", "a. "]
    hashes, first, n, ends = line_chunks.all_seeds(texts)
    assert len(ends) == len(texts) and ends[-1] == len(hashes) > 300
    for text, a, b in zip(texts, [0, *ends], ends):
        got = [x[a:b].tolist() for x in (hashes, first, n)]
        assert got == [x.tolist() for x in line_chunks.seeds(text)]
        pieces = [x for x in re.split(r"(?<=[.!?])(?= )|(?<=\n)", text) if x.strip()]
        assert [x.strip() for x in line_chunks.lines_of(text) if x.strip()] == [x.strip() for x in pieces]


def test_an_original_is_cut_into_lines_once(monkeypatch):
    cut, calls = line_chunks.lines_of, []
    monkeypatch.setattr(line_chunks, "lines_of", lambda text: calls.append(text) or cut(text))
    text, found = "A b.\nC d.\nE f.", [{"pos": 0, "first": 1, "n": 2}]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("first", pa.int32()), ("n", pa.int32())]))
    columns = {"_key": [1, 2, 3, 9, 4], "first_key": [9, 9, 9, 9, 8], "text": [text] * 5, "original": ["X.\nA b.\nC d."] * 5}
    batch = pa.RecordBatch.from_arrays(
        [*map(pa.array, columns.values()), pa.array([found] * 3 + [[{"pos": 1, "first": 0, "n": 2}], found], kind)], [*columns, "found"]
    )
    (out,) = line_chunks._compared([batch])
    assert out.column("places").to_pylist() == [[0, 1], [0, 1], [0, 1], [], [0, 1]]
    assert len(calls) == 7 and calls.count("X.\nA b.\nC d.") == 2
