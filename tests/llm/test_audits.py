"""Merkle manifest, filter audit and substring dedup against plain versions, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import op11_merkle as merkle
from larder.llm import op12_filter_audit as audit
from larder.llm import op13_substring as sub

CLASHING = ["grp", "at", "n", "total", "block", "members", "path", "root", "mask", "part", "digest", "words", "rid", "mark", "places", "h", "kept", "range", "copies"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# --- 11 ---------------------------------------------------------------------------------------------------------------


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_paths(digests):
    """The root of a list of digests, and for each the (before, after) pairs that lead to it."""
    paths, own, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(own):
            run = at // 8 * 8
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        level = [sha("".join(level[at : at + 8])) for at in range(0, len(level), 8)]
        own = [at // 8 for at in own]
    return level[0], paths


def brute_manifest(rows):
    """rows: (group, order, digest). A sorted list of (group or '', order or -1, digest, subroot, root, path)."""
    groups = {}
    for g, o, d in rows:
        groups.setdefault(g, []).append((o is not None, o, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_paths([d for _, _, d in sorted(groups[g])]) for g in names]
    root, above = brute_paths([t[0] for t in trees])
    return sorted(
        (g or "", -1 if o is None else o, d, top, root, p + up) for g, (top, paths), up in zip(names, trees, above) for (_, o, d), p in zip(sorted(groups[g]), paths)
    )


def ours(df):
    return sorted((r.lang or "", -1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in df.collect())


@pytest.mark.parametrize(
    "rows",
    [
        [("en", 1, sha("a"))],
        [(None, 1, sha("a")), ("", 1, sha("a"))],
        [("en", i, sha(str(i))) for i in range(9)] + [("é", 1, sha("b")), ("z", 2, sha("c")), (None, 3, sha("d"))],
        [("en", i, sha(str(i))) for i in range(1300)] + [("en", 700, sha("tie"))] + [(f"l{i}", i, sha(str(i))) for i in range(70)],
        [("en", 7, sha("same"))] * 1100 + [("en", None, sha("null"))] * 3 + [("en", 6, sha("before")), ("en", 8, sha("after"))],
    ],
    ids=["lone", "null and empty", "small", "rounds", "repeats"],
)
def test_manifest(spark, rows):
    df = spark.createDataFrame([(d, o, g) for g, o, d in rows], "leaf string, doc_id long, lang string").repartition(3)
    assert ours(merkle.manifest(with_clashes(df), "lang", ["doc_id"], "leaf")) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "leaf string, doc_id long, lang string")
    assert merkle.manifest(df, "lang", ["doc_id"], "leaf").collect() == []


def test_proofs(spark, tmp_path):
    """The query's columns: proofs, tampered leaves, byte lengths, nulls."""
    texts = ["Größe", None, "", "plain", "ÀBC", "x" * 100_000, "Same", "Same"]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", None if i == 3 else "s", i * 10) for i, t in enumerate(texts)] + [(None, "Null ID", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    manifest = brute_manifest([(lang, i, leaf(i, source, lang, n, t)) for i, t, lang, source, n in rows])
    paths = {d: (top, root, path) for _, _, d, top, root, path in manifest}
    for i, t, lang, source, n in rows:
        own = leaf(i, source, lang, n, t)
        top, root, path = paths[own]
        at = own
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None:
            at = leaf(i, source, lang, n, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        changed = at != own
        for before, after in path:
            at = sha(before + at + after)
        want[i] = (own, top, root, sha("".join(b + a for b, a in path)), at, not changed)
    got = {r.doc_id: tuple(r)[1:] for r in merkle.op11_merkle(spark, str(tmp_path)).collect()}
    assert got == want and {r[-1] for r in got.values()} == {True, False}


# --- 12 ---------------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    fails, first = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        said = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", "".join(k for k in "ABCDE" if bad[k]), any(q == 1 for _, q, _ in said), any(x == 1 for _, _, x in said)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        orders = ["".join(p) for p in permutations("ABCDE")]
        cells = {}
        for o in orders:
            left = own
            for k, f in enumerate(o, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                cells[o, k] = [len(left), len(gone), redundant, sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        total = {f: sum(cells[o, o.index(f) + 1][1] for o in orders) for f in "ABCDE"}
        out |= {(part, o, k): (*cells[o, k], total[o[k - 1]]) for o, k in cells}
    return out


def audit_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([8, 60, 300])]) for _ in range(rng.choice([3, 49, 50, 120]))) for _ in range(40)]
    texts += [t + " & more" for t in texts[:8]] + [t.upper() for t in texts[:6]] + [None, "", " \t\n", "\x0b", "É" * 60, "a b " * 20_000]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(200)] + [(5, texts[0], "a"), (5, texts[0], "a"), (None, texts[0], "b"), (None, texts[0], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(9))
    got = audit.audit(audit.counted(audit.failures(with_clashes(df)), said)).collect()
    want = brute_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.counted(audit.failures(docs), labels)).collect() == []
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert audit.audit(audit.counted(audit.failures(one), labels)).count() == 600


def test_min_plus():
    rng = np.random.default_rng(2)
    masks = rng.permutation(16)[:9]
    orders, at = audit.positions(4)
    for m, steps in zip(masks, audit.removal_steps(masks, 4)):
        assert [min((k for k, f in enumerate(o) if m >> f & 1), default=4) for o in orders] == steps.tolist()


# --- 13 ---------------------------------------------------------------------------------------------------------------


def brute_kept(texts, window):
    """(words, kept words) of each text."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def passage_texts(seed, vocabulary, count):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 9 else f"W{i}é" for i in range(vocabulary)]
    run = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [run(rng.choice([34, 35, 36, 50, 70, 200])) for _ in range(8)]
    texts = []
    for _ in range(count):
        parts = [run(rng.choice([0, 1, 5, 40])) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "  ", "\n", "\t\x0b"]).join(w for p in parts for w in p))
    texts += [texts[0], texts[0] + " ", texts[1].upper(), None, "", " \n ", "one", "again " * 34, "again " * 90, "again " * 20_000, " ".join(shared[5] * 300)]
    return texts


@pytest.mark.parametrize("window,vocabulary", [(35, 500), (35, 2), (70, 300), (20, 40), (5, 30)])
def test_substrings(spark, window, vocabulary):
    texts = passage_texts(window, vocabulary, 120)
    rows = [(None if i % 17 == 0 else i % 90, t) for i, t in enumerate(texts)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    want = sorted((-1 if i is None else i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, _), (n, kept) in zip(rows, brute_kept(texts, window)))
    got = sub.kept_words(df, window, text=False).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got) == want


def test_substrings_by_filter_and_join(spark, monkeypatch):
    """The ways of large tables: no Bloom filters, long documents in several rows."""
    monkeypatch.setattr(sub, "SENT", 0)
    monkeypatch.setattr(sub, "ENTRIES", 64)
    texts = passage_texts(3, 400, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept.split()) for r in sub.kept_words(df).collect()}
    assert got == {i: x for i, x in enumerate(brute_kept(texts, 35))}


def test_spans(spark):
    assert sub.spans_of(np.array([9, 3, 4, 30]), 5) == [{"begin": 3, "end": 14}, {"begin": 30, "end": 35}]
    assert sub.lengths(35) == [18, 35] and sub.lengths(100) == [25, 50, 100] and sub.lengths(20) == [20]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sub.kept_words(empty).collect() == [] and sub.kept_words(empty, text=False).collect() == []


def test_stand_ins():
    """Equal windows choose the same part; long texts are looked at piece by piece."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 50, 200_000, dtype=np.uint64)
    got = sub.stand_ins(hashes, 18, 35)
    assert len(got) == len(hashes) - 17
    for i in [0, 1, 65_535, 65_536, 65_537, 131_071, len(got) - 1, *rng.integers(0, len(got), 500)]:
        assert got[i] == i + int(hashes[i : i + 18].argmin())
