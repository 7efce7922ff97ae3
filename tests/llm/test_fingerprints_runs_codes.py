"""Fingerprints, periodic runs and part codes beside brute force, on small tables with nulls, empty texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, id string, part int, fingerprint int, runs int, start string"


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(some(rng.randint(1, 80))) for _ in range(50)]
    for _ in range(30):  # periodic stretches within, some nested, some too short
        unit = some(rng.randint(1, 9))
        inner = unit * rng.randint(2, 30) + unit[: rng.randint(0, len(unit))]
        outer = (inner + some(rng.randint(0, 3))) * rng.randint(1, 4)
        texts.append("\n ".join(some(rng.randint(0, 30)) + outer + some(rng.randint(0, 30))))
    texts += [None, "", " \t\n", "x", "É", "ab", "😀😀😀😀 ß", "same " * 4000, texts[3], texts[3].upper(), " ".join(some(6000))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[9]), (None, None), (21, texts[11]), (-5, texts[60])]
    return [(i, t, "clash", 1, 2, 3, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- periodic runs


def plain_runs(words, shortest=24, times=3):
    """Every stretch of every period, the smallest period first."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, times * q) and not any(s <= i and i + length <= s + n and q % p == 0 for (s, p), n in found.items()):
                found[i, q] = length
            i = j + 1
    return [(s, n, q) for (s, q), n in sorted(found.items())]


def plain_document(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-(r[1] * math.factorial(20) // r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_runs_are_those_of_every_period():
    from variantloom.llm.periodic_runs import candidates, runs

    rng = random.Random(2)
    several = 0
    for _ in range(400):
        kinds, words = rng.randint(1, 4), []
        for _ in range(rng.randint(0, 6)):
            words += [rng.randrange(kinds) for _ in range(rng.randint(0, 20))]
            unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 8))]
            words += unit * rng.randint(1, 12) + unit[: rng.randint(0, len(unit))]
        shortest = rng.choice([2, 6, 24])
        want = plain_runs(words, shortest)
        assert runs(words, shortest) == want
        cut = candidates(np.array(words, dtype=np.int64), np.zeros(len(words), dtype=np.int64), shortest, 3)
        assert sorted((a + s, n, q) for a, b in cut for s, n, q in runs(words[a:b], shortest)) == want
        several += len(want) > 1
    assert several > 100


def test_a_collision_of_hashes_is_noticed(monkeypatch):
    from variantloom.llm import periodic_runs

    monkeypatch.setattr(periodic_runs, "MODULUS", 3)
    rng = random.Random(4)
    with pytest.raises(ArithmeticError):
        for _ in range(50):
            periodic_runs.runs([rng.randrange(3) for _ in range(200)])


def test_periodic_runs_of_documents(docs, empty):
    from variantloom.llm.periodic_runs import find_runs

    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in find_runs(docs, repeat_tails=True, texts_out=False).collect()]
    want = [plain_document(r[0], r[1]) for r in documents()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) > 20 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got if r[1])
    assert find_runs(empty).count() == 0


def test_collapsed_texts_and_runs(docs):
    from variantloom.llm.periodic_runs import find_runs

    for r in find_runs(docs).collect():
        assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
        assert r["n_runs"] == len(r["runs"]) and (r["start"] is None) == (r["n_runs"] == 0)
    with pytest.raises(ValueError):
        find_runs(docs, times=2)


# --- fingerprints


def weights(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {w: n * len(w.encode()) for w, n in collections.Counter(words).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    over = sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) / over if over else 1.0


def test_samples_are_those_of_every_word_by_itself():
    """The smallest value over the words, worked out word by word."""
    from variantloom.llm.fingerprints import draws, fingerprints_of, sampled
    from variantloom.llm.textbytes import bytes_of, chunks, word_hashes

    import pyarrow as pa

    text = "one two two three THREE three é"
    data, offsets = bytes_of(pa.array([text]))
    hashes = {}
    for _, x, begin in chunks(data, offsets, 1, 10):
        h, _ = word_hashes(x, begin)
        hashes = dict(zip(text.lower().split(), h.astype(np.uint64)))
    got = fingerprints_of([text], 300)[0]
    for k in range(300):
        best = None
        for w, weight in weights(text).items():
            r, log_c, b = (x[0] for x in draws(np.array([hashes[w]]), k))
            t = math.floor(np.float32(math.log(weight)) / r + b)
            value = log_c - r * (t - b) - r
            if best is None or value < best[0]:
                best = value, w, weight
        alone = sampled(np.zeros(1, np.int64), np.array([hashes[best[1]]]), np.array([best[2]]), 1, k + 1)
        assert alone[0, k] == got[k]


def test_agreement_is_the_generalised_jaccard_similarity():
    from variantloom.llm.fingerprints import fingerprints_of

    rng = random.Random(8)
    texts = []
    for _ in range(120):
        words = [f"w{int(rng.paretovariate(0.4)) % 10**6}" for _ in range(rng.randint(1, 150))]
        texts += [" ".join(words), " ".join(words[: rng.randint(0, len(words))] + [f"v{rng.randrange(50)}" for _ in range(rng.randint(0, 60))] + words[:5])]
    prints = fingerprints_of(texts, 1024)
    off = [(prints[i] == prints[i + 1]).mean() - jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert max(map(abs, off)) < 0.08 and abs(np.mean(off)) < 0.01


def test_fingerprints_of_edits(docs, empty):
    from variantloom.llm.fingerprints import fingerprint, fingerprint_edits, fingerprints_of

    rows = [(r[0], r[1] or "") for r in documents()]
    own = {t: fingerprints_of([t], 128)[0] for _, t in rows}
    spark = docs.sparkSession
    place = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), place[r[1]], r[1]))
    want = []
    for (i, t), (_, o) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + o[:n]
        f = fingerprints_of([e], 128)[0]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own[t].tobytes().hex(), f.tobytes().hex(), float((own[t] == f).mean()), float((own[t] == own[o]).mean())))
    key = lambda r: tuple((x is not None, x) for x in r)
    for some in (docs, docs.coalesce(1)):
        assert sorted((tuple(r) for r in fingerprint_edits(some).collect()), key=key) == sorted(want, key=key)
    assert fingerprint_edits(empty).count() == 0
    one = fingerprint_edits(docs.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert {bytes(r["fingerprint"]) for r in fingerprint(docs).collect()} == {f.tobytes() for f in own.values()}


# --- part codes


def plain_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for *_, v in kept), default=0)
    width = max(1, -(-dims // parts))
    kept = [(i, label, v + [0] * (parts * width - len(v)), v) for i, label, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def told():
        out = []
        for r in kept:
            gaps = [[sum((a - b) ** 2 for a, b in zip(cut(r[2], p), c)) for c in books[p]] for p in range(parts)]
            out.append([(g.index(min(g)), min(g)) for g in gaps])
        return out

    for _ in range(rounds):
        now = told()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[2], p) for r, t in zip(kept, now) if t[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return [(r[0], r[1], "".join(f"{e:02x}" for e, _ in t), sum(g for _, g in t)) for r, t in zip(kept, told())], books


def vectors(dims, n=70, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(dims)], rng.choice([1, 2, None])) for i in rng.sample(range(1000), n)]
    rows += [(5, None, 1), (6, [None] * dims, 2), (7, [float("nan")] * dims, 2), (8, [float("inf")] + [0.0] * (dims - 1), None), (9, [-0.0] * dims, 3), rows[0], rows[0], (None, rows[1][1], 2), (rows[2][0], rows[3][1], 1)]
    return rows


@pytest.mark.parametrize("dims,parts,entries,rounds", [(8, 4, 256, 4), (8, 4, 6, 4), (7, 3, 5, 2), (4, 1, 3, 0), (2, 4, 4, 3)])
def test_part_codes_are_those_of_full_rounds(spark, dims, parts, entries, rounds):
    from variantloom.llm.part_codes import compress, with_label_errors

    rows = vectors(dims)
    if dims == 7:  # shorter vectors end in zeros
        rows += [(2000, [1.0, -1.0], 1), (2001, [], None)]
    df = spark.createDataFrame([(i, v, x, "clash", 0) for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    found = compress(df, label_col="label", parts=parts, entries=entries, rounds=rounds)
    want, books = plain_codes(rows, parts, entries, rounds)
    assert found.codebooks.tolist() == books
    key = lambda r: tuple((x is not None, x) for x in r)
    text = lambda x: None if x is None else str(x)
    per_label = collections.Counter()
    for _, label, _, error in want:
        per_label[text(label)] += error
    want = sorted([(i, text(label), c, e, per_label[text(label)]) for i, label, c, e in want], key=key)
    for few in (1000, 0):  # broadcast, and dealt by salt
        got = [tuple(r) for r in with_label_errors(found.rows, few=few).select("id", "label", "code", "error", "label_error").collect()]
        assert sorted(got, key=key) == want
    assert len(found.decoded(want[0][2])) == books[0][0].__len__() * parts


def test_part_codes_of_no_rows(spark):
    from variantloom.llm.part_codes import compress, with_label_errors

    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    for some in (df, df.limit(0)):
        found = compress(some, label_col="label")
        assert with_label_errors(found.rows).count() == 0 and len(found.sha256) == 64


def test_nearest_is_exact_for_large_numbers():
    from variantloom.llm.part_codes import LARGEST, nearest

    x = np.array([[LARGEST, LARGEST - 1], [-LARGEST, 3]])
    book = np.array([[LARGEST - 1, LARGEST - 1], [LARGEST, LARGEST - 2], [0, 0]])
    found, far = nearest(x, book)
    assert found.tolist() == [0, 2] and far.tolist() == [1, LARGEST**2 + 9]


def test_part_codes_beside_their_sql(spark):
    import duckdb

    from variantloom.llm.queries import ORACLES, op13_part_codes

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(tuple(r) for r in op13_part_codes(spark, sf).select(*names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op13_part_codes']})").fetchall())
