"""Vectors, manifest and spelling variants against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from duskrank.llm import merkle, spelling, spherical_caps


# ---- op11

VECTORS = "vec_id long, embedding array<float>, label int, node long, copies int, filter string"


@pytest.fixture(scope="module")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, e, y, 7, 7, "x") for i, e, y in rows], VECTORS)

    return make


def clouds(dims, seed, groups=6, members=12, noise=0.16):
    """Groups of vectors around centres, at angles on both sides of the threshold."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(members):
            x = centre + noise * rng.random() * np.linalg.norm(centre) / math.sqrt(dims) * rng.standard_normal(dims)
            rows.append((x * rng.uniform(0.1, 10), int(g % 3)))
    return rows


def brute_links(rows, threshold=0.98):
    """(n_links, component, kept) from all pairs."""
    unit = []
    for _, e, y in rows:
        ok = y is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        v = np.array(e, np.float32).astype(float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    links = [
        [j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
         and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
        for i in range(len(rows))
    ]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least, not links[i] or rows[i][0] == least))
    return sorted(out, key=repr)


def got_links(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dims", [1, 2, 3, 7, 8, 33, 64, 300])
def test_links_equal_brute_force(make_vectors, dims):
    rows = [(k, [float(x) for x in e], y) for k, (e, y) in enumerate(clouds(dims, dims))]
    want = brute_links(rows)
    assert any(r[1] for r in want)
    assert got_links(spherical_caps.near_vectors(make_vectors(rows))) == want


def test_tiles_of_a_hot_bucket_count_every_pair_once(make_vectors):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(k, [float(x) for x in base + 0.1 * rng.standard_normal(64)], 1) for k in range(150)]
    want = brute_links(rows)
    for tile in (8, 64, 512):
        assert got_links(spherical_caps.near_vectors(make_vectors(rows), tile=tile)) == want


def test_vector_edges(make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [2.0, 4.0, 6.0], 1), (3, [1.0, 2.0, 3.0], 2),
        (4, [1.0, 2.0, 3.0], None), (5, [1.0, 2.0, 3.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1), (11, [1.0, nan, 3.0], 1), (12, [1.0, inf, 3.0], 1),
        (None, [1.0, 2.0, 3.0], 1), (None, [5.0, 0.0, 0.0], 1), (13, [1.0, 2.0], 1), (14, [1e30, 2e30, 3e30], 1),
        (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, -0.0], 3),
    ]
    df = spherical_caps.near_vectors(make_vectors(rows))
    assert got_links(df) == brute_links(rows)
    assert [f"{n} {t}" for n, t in df.dtypes] == ["vec_id bigint", "n_links bigint", "component_id bigint", "kept boolean"]
    assert spherical_caps.near_vectors(make_vectors([])).count() == 0


def test_list_decoding_finds_exactly_the_exceeding_directions():
    rng = np.random.default_rng(2)
    unit = spherical_caps.unit_rows(rng.standard_normal((40, 12)))
    blocks, words, height = spherical_caps.code_shape(12)
    rotation, lists = spherical_caps.code(12, 5)
    row, found = spherical_caps.exceeding(unit, 5)
    turned = unit @ rotation
    scores = (turned[:, :6] @ lists[0])[:, :, None] + (turned[:, 6:] @ lists[1])[:, None, :]
    want = np.argwhere(scores.reshape(40, -1) >= height)
    assert sorted(zip(row.tolist(), found.tolist())) == [(a, 5 * words**2 + b) for a, b in want.tolist()]


def test_share_of_pairs_at_the_threshold_that_meet():
    rng = np.random.default_rng(8)
    a = spherical_caps.unit_rows(rng.standard_normal((800, 64)))
    side = rng.standard_normal(a.shape)
    side = spherical_caps.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
    b, met = 0.98 * a + math.sqrt(1 - 0.98**2) * side, np.zeros(800, bool)
    for number in range(spherical_caps.CODES):
        one, two = (set(zip(*map(np.ndarray.tolist, spherical_caps.exceeding(x, number)))) for x in (a, b))
        met[[row for row, _ in one & two]] = True
    assert met.all()


# ---- op12


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute_tree(nodes):
    """(root, siblings of every leaf as [(left, right) per level])."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, p in enumerate(at):
            first = p // 3 * 3
            paths[leaf].append((level[first:p], level[p + 1 : first + 3]))
            at[leaf] = p // 3
        level = [h("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) by the definition, tampering included."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = brute_tree([brute_leaf(r) for r in by_source[s]])
    root, up = brute_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, up, strict=True):
        for r, path in zip(by_source[s], trees[s][1], strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = brute_leaf((*r[:4], text)), ""
            for left, right in path + above:
                proof += "".join(left + right)
                node = h("".join([*left, node, *right]))
            out.append((r[0], brute_leaf(r), trees[s][0], root, h(proof), node, node == root))
    return sorted(out, key=repr)


def got_manifest(df, **more):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.without_newlines(df), **more).collect()), key=repr)


def test_manifest_equals_brute_force(spark, prose):
    rng = random.Random(6)
    rows = []
    for k in range(700):
        text = prose(k % 50, 5)
        source = rng.choice(["big"] * 12 + ["b", "B", "é", "ab", "", None])
        rows.append((k * 7 % 701, source, "en", len(text), text))
    rows += [(5000 + k, f"host{k}", None, None, None) for k in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = brute_manifest(rows)
    assert 0 < sum(r[6] for r in want) < len(want)
    for block_levels in (0, 1, 2, 7):  # blocks of 1, 3 and 9 leaves, and a block for every source
        assert got_manifest(df, block_levels=block_levels) == want


def test_manifest_edges(edge_docs, no_docs, make_docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    for df in (edge_docs, make_docs([(1, "a\nb", "s")]), make_docs([(9, "x\ny", None)] * 40 + [(None, None, None)] * 7)):
        rows = [tuple(r[c] for c in columns) for r in df.collect()]
        assert got_manifest(df) == brute_manifest(rows)
        assert got_manifest(df, block_levels=1) == brute_manifest(rows)
    assert got_manifest(no_docs) == []


def test_a_round_sends_a_block_to_two_others(spark):
    """Every block's runs hold the siblings of its own way, whatever the number of blocks."""
    for n in (1, 2, 3, 4, 9, 10, 28, 55):
        nodes = [h(str(k)) for k in range(n)]
        roots = spark.createDataFrame([("s", k, n, x) for k, x in enumerate(nodes)], "name string, block long, n long, root string")
        root, paths = brute_tree(nodes)
        for r in merkle.butterfly(roots, 1).collect():
            assert r.top == root
            assert merkle.siblings(r.runs, r.block) == "".join("".join(a + b) for a, b in paths[r.block])
            assert merkle.fold(nodes[r.block], r.runs, r.block) == root


# ---- op13


def brute_variants(rows, least=5):
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | set(map(chr, range(0xC0, 0x100)))
    counts = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c in letters else " " for c in text or "").split(" "):
            run = "".join(c.lower() if c < "[" else c for c in run)
            x = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if run and x % 199 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by_length, others = {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        others[w] = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and near(v, w)]
    form = {}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got_variants(df, **more):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r[c] for c in columns) for r in spelling.variants(df, **more).collect())


@pytest.fixture(scope="module")
def misspelt(make_docs, words):
    """Texts with frequent words, misspellings of them, chains of misspellings, accents and long runs."""
    rng, texts = random.Random(12), []
    pool = [w for w in words if len(w) >= 6][:400] + ["façade", "facade", "éclair", "ÉCLAIR", "eclair", "naïveté", "ÿÿÿÿÿÿ×"]
    chain = [("planets", 700), ("planetz", 130), ("planetzz", 24), ("planeizz", 4), ("planeizs", 5)]
    for k in range(260):
        base = rng.choices(pool, [1 / (1 + i) for i in range(len(pool))], k=80)
        for i in range(0, 80, 9):
            w = base[i]
            at = rng.randrange(len(w))
            base[i] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "q" + w[at + 1 :], w.upper()])
        texts.append(rng.choice([" ", "\n", ", ", "1"]).join(base))
    texts += [" ".join([w] * n) for w, n in chain]
    return make_docs([(rng.choice([k, None, k // 2]), t, "a") for k, t in enumerate(texts)])


def test_variants_equal_brute_force(misspelt):
    want = brute_variants([(r.doc_id, r.text) for r in misspelt.collect()])
    assert sum(r[1] is not None for r in want) > 20 and sum(r[2] not in (r[0], r[1]) for r in want) > 0
    assert got_variants(misspelt) == want
    assert got_variants(misspelt, block=16) == want


def test_variants_of_odd_texts(edge_docs, no_docs, make_docs):
    for df in (edge_docs, make_docs([(1, "ab" * 9 + " x" * 50, "s")] * 6 + [(2, "y" * 300_000, "s")] * 5 + [(3, "y" * 300_001, "s")] * 30)):
        assert got_variants(df) == brute_variants([(r.doc_id, r.text) for r in df.collect()])
    assert got_variants(no_docs) == []


def test_near_pairs_are_all_found_and_no_others():
    rng = random.Random(3)
    make = lambda size: list({"".join(rng.choices("abcé", k=size)) for _ in range(400)})
    for a, b in (((s := make(6)), s), (make(6), make(7)), (make(7), make(7))):
        got = set(zip(*map(np.ndarray.tolist, spelling.near_pairs(a, b))))
        same = len(a[0]) == len(b[0])
        want = {
            (i, j) for i, x in enumerate(a) for j, y in enumerate(b)
            if (sum(p != q for p, q in zip(x, y)) == 1 if same else any(y[:k] + y[k + 1 :] == x for k in range(len(y))))
        }
        assert got == want


def test_roots_of_long_chains(spark):
    names = [f"w{k:03d}" for k in range(40)]
    forms = spark.createDataFrame(list(pairwise(names)), "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w039"}
