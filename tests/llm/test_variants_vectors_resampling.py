"""Spelling variants, near vectors and resampling against plain programs on small inputs."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import crc, near_vectors, resampling, spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    (1, "Granite granite granitE granit granit granit grannite grannite grannite"), (2, None), (3, ""), (4, " \t"), (5, "x" * 20_000),
    (6, "Straße STRASSE straße Straße stra×e ñandú ÑANDÚ ñandú ñandu ñandu ñandu"), (6, "Straße STRASSE straße Straße"), (None, "no id here here here here"),
    (7, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)) * 4), (8, "日本語 granite 10 words, of-text! 2024"), (8, "日本語 granite 10 words, of-text! 2024")]
SCHEMA = "doc_id long, text string, Word string, n long, rank string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, every=spelling.EVERY):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [n[w], len(found), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


@pytest.mark.parametrize("every,most", [(97, 4096), (2, 3)])
def test_spelling_variants_are_those_of_all_pairs(docs, every, most):
    got = spelling.variant_groups(docs, every=every, most=most).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(TEXTS, every)
    assert len(got) == len({r["word"] for r in got})


def test_no_words_no_variants(spark, none):
    assert spelling.variant_groups(none).count() == 0
    assert spelling.variant_groups(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0


def test_trie_pairs_are_all_pairs_at_distance_one():
    rng = np.random.default_rng(3)
    words = list({"".join(rng.choice(list("abé"), int(rng.integers(1, 7)))) for _ in range(250)})
    got = [tuple(sorted((words[a], words[b]))) for a, b in spelling.trie_pairs(words)]
    assert len(got) == len(set(got))
    assert set(got) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p)}


def test_roots_follow_long_paths(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert len(got) == 37 and {r["root"] for r in got} == {"w37"}


def plain_links(rows, threshold=near_vectors.THRESHOLD):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        v = v / np.abs(v).max()
        return v / np.sqrt(v @ v)

    units = [unit(v) for _, v, _ in rows]
    links = {k: set() for k in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
            if units[i] @ units[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    seen, out = {}, []
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        seen |= dict.fromkeys(group, least)
    for k, (vec, _, _) in enumerate(rows):
        out.append((vec, len(links[k]), seen[k], vec == seen[k]))
    return sorted(out, key=repr)


def answers(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, v int, n_links string"


def test_vector_cases(spark):
    a = [0.5, 0.1, -0.3]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (3, [1e200 * x for x in a], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1),
        (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (12, a[:2], 1), (13, [1e-200 * x for x in a], 1), (None, a, 1), (None, a, 3),
        (14, [0.5, 0.1, -0.31], 1), (15, [-x for x in a], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    assert answers(near_vectors.near_vectors(df)) == plain_links(rows)
    assert near_vectors.near_vectors(df.filter("false")).count() == 0


def test_dense_groups_beyond_a_window_are_whole(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((4, 24))
    rows = [(k, (base[k % 4] + rng.standard_normal(24) * 0.05).astype(np.float32).tolist(), 1) for k in range(400)]  # four groups of a hundred
    rows += [(1000 + k, rng.standard_normal(24).astype(np.float32).tolist(), 1) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert answers(near_vectors.near_vectors(df, block=8)) == plain_links(rows)


def test_recall_of_vector_links_by_band(spark):
    """Pairs planted at cosines from the threshold on, with blocks so small that few vectors meet by chance."""
    rng, rows, planted = np.random.default_rng(4), [], collections.defaultdict(list)
    for k in range(1500):
        x, y = rng.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.931 + 0.068 * rng.random()
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y).tolist(), 1)]
        planted[min(3, int((c - 0.93) / 0.0175))].append(2 * k)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df, block=16).collect()}
    assert len(got) == len(rows)
    for ids in planted.values():
        assert np.mean([got[i] > 0 for i in ids]) >= 0.97


def test_crc_of_joined_strings():
    rng = np.random.default_rng(2)
    pairs = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 400, (200, 2))] + [(b"", b""), (b"x", b"")]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = crc.joined(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def plain_features(text, least, most):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(least, most + 1) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("grams", [(1, 1), (1, 3), (2, 2), (3, 5)])
def test_gram_crcs_are_those_of_the_strings(grams):
    texts = pa.array([t for _, t in TEXTS] + ["a", "", "b c", "é ü\x00z"])
    got, text, n_words = resampling.gram_crcs(texts.slice(1), *grams)
    for k, t in enumerate(texts.slice(1).to_pylist()):
        w, features = plain_features(t, *grams)
        assert n_words[k] == len(w) and sorted(got[text == k].tolist()) == sorted(features)
    assert len(resampling.gram_crcs(pa.array([], pa.string()), *grams)[0]) == 0


@pytest.mark.parametrize("grams", [(1, 1), (1, 2)])
def test_resampling_equals_a_plain_program(spark, docs, grams):
    target = [(1, "granite words of text here 2024"), (2, None), (3, "ñandú granite granite")]
    rows = TEXTS + [(100 + k, " ".join(f"w{(k * j) % 17}" for j in range(k))) for k in range(60)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(f % 500 for f in plain_features(text, *grams)[1])
    for _, text in target:
        t.update(f % 500 for f in plain_features(text, *grams)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 500) / ((s[b] + 1) * (all_t + 500)))) for b in range(500)]
    expected = []
    for doc, text in rows:
        w, features = plain_features(text, *grams)
        weight = sum(gain[f % 500] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        expected.append([doc, len(w), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((e for e in expected if e[1] >= 20), key=lambda e: (-e[4], e[0] is None, e[0] or 0))
    drawn = {id(e): k + 1 for k, e in enumerate(fit[: 30 * len(fit) // 100])}
    got = resampling.resample(df, spark.createDataFrame(target, "item_id long, text string"), grams, 500, percent=30).collect()
    plain = [(*e, drawn.get(id(e))) for e in expected]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain))


def test_resampling_cases(spark, docs, none):
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(docs, none).count() == len(TEXTS)
    kept = resampling.drawn(docs, docs, percent=100, least_words=0)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert resampling.drawn(docs, none, percent=50).filter(F.col("doc_id") == 2).count() == 0
