"""The training-data operators beside brute force, on small tables with nulls, empty texts, ties and repeats."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node int, size int"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 60))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies, chains of them too
        words = texts[i].split()
        words[-1] = "changed"
        texts.append(" ".join(words))
        texts.append(" ".join(["Other", *words[1:]]))
    texts += [texts[0], texts[0].upper(), None, "", " \n\t", "one two", "ONE  two", "x", " ".join(rng.choice(vocabulary) for _ in range(9000))]
    return [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "é"][i % 4], None, "clash", 7, 8) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_parity_join_is_exact(docs, empty):
    from variantloom.llm.parity_join import near_duplicates

    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == jaccard_components(corpus())
    assert near_duplicates(empty).count() == 0


def test_parity_join_in_crowded_blocks(spark):
    """Many near copies of one text: pieces, fine pairs and several rounds are all in use."""
    from variantloom.llm.parity_join import near_duplicates

    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(40)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=8, piece=16, common_in=2).collect()}
    assert got == jaccard_components(rows)


def test_parity_join_of_long_texts(spark):
    """Sets of 130 to 3000 shingles, where a block holds several bits: near the threshold on both sides, repeated and null ids."""
    from variantloom.llm.parity_join import near_duplicates

    rng = random.Random(6)
    rows = []
    for n in (140, 260, 300, 520, 900, 1500, 3000):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for share in (0.005, 0.02, 0.028, 0.035, 0.06):
            words = list(base)
            for at in rng.sample(range(n), int(n * share)):
                words[at] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[: int(n * 0.8)])))
        rows.append((len(rows), " ".join(base[: int(n * 0.7)])))
    docs = spark.createDataFrame(rows + [rows[0], (None, rows[8][1])], "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect() if r["id"] is not None}
    want = jaccard_components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 14


def test_sketches_never_rule_out_a_link():
    from variantloom.llm.parity_join import _distances, _sketches

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**56, 12_000, dtype=np.uint64)
    sets = [np.unique(pool[:9000]), np.unique(pool[500:9700]), np.unique(pool[:700]), np.unique(pool[6000:])]
    size = np.array([len(s) for s in sets])
    sketch = _sketches(np.concatenate(sets), np.repeat(np.arange(4), size), size)
    for i in range(4):
        for j in range(4):
            assert _distances([sketch[i]], [sketch[j]])[0] <= len(np.setxor1d(sets[i], sets[j]))


def test_components(spark):
    from variantloom.llm.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(101, 100), (100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_meets_its_targets(docs, empty):
    from variantloom.llm.common import word_count
    from variantloom.llm.mixing import mix_sources

    sized = docs.drop("size").withColumn("size", word_count(F.col("text")))
    rows = mix_sources(sized, bucket_rows=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(sized.repartition(3)).collect()))  # reruns and range sizes agree
    own = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r["size"] == own[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert len(rows) == len(own) and all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s] for s in target)
    assert mix_sources(empty.drop("size").withColumn("size", F.lit(1))).count() == 0


def test_fuzzy_lines(spark, empty):
    from variantloom.llm.line_dedup import dedup_lines

    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    near = line.replace("old", "old old")  # the same words: one SimHash, another text
    rows = [(2, f"{line}\nunique words here\n\n***"), (1, f"first\n{line.upper()}."), (3, f"{near}\nlast"), (4, None), (5, ""), (None, line), (6, "***\n***"), (1, f"first\n{line.upper()}."), (7, "short line\nshort line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_kept", F.lit("clash")).withColumn("line", F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_kept"]) for r in dedup_lines(docs).collect() if r["text"] is not None)
    assert got == [
        (0, line, 1, 1), (1, f"first\n{line.upper()}.", 2, 2), (1, f"first\n{line.upper()}.", 2, 2), (2, "unique words here\n\n***", 4, 3), (3, "last", 2, 1), (5, "", 1, 1), (6, "***\n***", 2, 2), (7, "short line", 2, 1),
    ]
    assert dedup_lines(empty).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    """Few words, one word of many, no blanks, characters beyond 16 bits, edits at the threshold: every pair is found."""
    from variantloom.llm.line_dedup import dedup_lines

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(11)
    alphabets = ["abcdefghij klmnop ", "国語中文日本字漢写真電車", "\U00020000\U00020001\U00020002\U00020003abc"]
    lines = []
    for n in (9, 10, 11, 19, 20, 27, 45, 60, 88, 90, 99, 100, 131, 240):
        for letters in alphabets:
            base = [rng.choice(letters) for _ in range(n)]
            lines.append("".join(base))
            for edits in (1, max(1, n // 20), n // 10, n // 10, n // 10 + 1):
                own = list(base)
                for _ in range(edits):
                    at, kind = rng.randrange(len(own)), rng.randrange(3)
                    own[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(letters)]
                lines.append("".join(own))
    lines = [" ".join(x.split()) for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(lines):
        for j in range(i):
            most = max(len(a), len(lines[j]))
            if abs(len(a) - len(lines[j])) <= most // 10 and find(i) != find(j) and distance(a, lines[j]) <= most // 10:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    got = {r["doc_id"]: r["n_kept"] for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: int(find(i) == i) for i in range(len(lines))}
    assert 14 < sum(got.values()) < len(lines) - 60


def test_fuzzy_lines_by_kind_of_edit(spark):
    """Pairs within 90% edit similarity by a letter or two, a word, an inserted word, a tenth of the words, at 8 to 100 words: all are found."""
    from variantloom.llm.line_dedup import dedup_lines

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], collections.defaultdict(list)
    for n in (8, 12, 20, 40, 100):
        for kind in ("letter", "letters", "word", "insert", "tenth"):
            for _ in range(40):
                words = rng.choices(vocabulary, k=n)
                other = list(words)
                for at in rng.sample(range(n), {"letter": 1, "letters": 2, "word": 1, "insert": 0, "tenth": max(1, n // 10)}[kind]):
                    x = other[at]
                    i = rng.randrange(len(x))
                    other[at] = x[:i] + rng.choice(letters) + x[i + 1 :] if kind.startswith("letter") else rng.choice([w for w in vocabulary if len(w) <= len(x)])
                if kind == "insert":
                    other.insert(rng.randrange(n), rng.choice([w for w in vocabulary if len(w) < 4]))
                a, b = " ".join(words), " ".join(other)
                changed = sum(max(len(x), len(y)) for x, y in zip(words, other) if x != y) if kind != "insert" else 4
                if a != b and 10 * changed <= len(a):  # an upper bound of the distance
                    pairs[n, kind].append(len(rows) + 1)
                    rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r["doc_id"]: r["n_kept"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (n, kind), later in pairs.items():
        found = sum(got[i] == 0 for i in later) / len(later)
        assert found == 1, (n, kind, found)
    first = {i for later in pairs.values() for i in later}
    assert all(got[i] == 1 for i, _ in rows if i not in first)


def test_packing_round_trip(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from variantloom.llm.packing import pack

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in corpus()}
    covered, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in pack(docs, path).collect():
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r["id"]] += range(r["start"], r["start"] + r["length"])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(len(v))) for i, v in ids.items()}
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty, path).count() == 0


def test_differencing_levels_and_adds_windows():
    from variantloom.llm.packing import differencing, windows

    sizes = np.random.default_rng(1).integers(1, 900, 200)
    parts = differencing(sizes, 60)
    loads = [int(sizes[p].sum()) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(200)) and max(loads) - min(loads) < 200
    dealt = windows(np.array([6, 6, 6]), 10)
    assert len(dealt) == 3


def test_context_tree_counts_and_base_score(docs, empty):
    """Token counts and the base score by a plain computation; of the code length only the sign."""
    from variantloom.llm.ctw import score_texts

    few, depth = docs.filter("doc_id < 12 or doc_id between 80 and 92"), 2
    rows = {r["id"]: r for r in score_texts(few, F.col("doc_id") % 5 != 1, depth=depth).collect()}
    texts = {r["doc_id"]: re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "") for r in few.collect()}

    tokens = collections.Counter()
    for i, t in texts.items():
        if i % 5 != 1:
            tokens.update(WORD.findall(t) + [None])
    n, v = sum(tokens.values()), len(tokens)
    for i, t in texts.items():
        own = WORD.findall(t) + [None]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert rows[i]["n_tokens"] == len(own) and rows[i]["train_tokens"] == n and abs(rows[i]["base_score"] - base) < 1e-6
        assert rows[i]["n_known"] == sum(tokens[w] > 0 for w in own) and rows[i]["score"] <= 0
    assert score_texts(empty, F.lit(True)).count() == 0


def test_context_tree_against_a_plain_tree(spark):
    """Every score by dictionaries of nodes, depth 2: Krichevsky-Trofimov estimates and posterior weights of all depths met."""
    from variantloom.llm.ctw import score_texts

    depth, texts = 2, ["abab abba", "Abc é", "", "zz top", "abab abba", "abba cab zed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["score"] for r in score_texts(docs, F.col("doc_id") != 5, depth=depth).collect()}
    ones, zeros, longer = collections.Counter(), collections.Counter(), collections.defaultdict(set)

    def places(text):
        data = [255] * depth + list(re.sub("[A-Z]", lambda m: m.group().lower(), text).encode()) + [255]
        for at in range(depth, len(data)):
            context, byte = tuple(data[at - 1 - j] for j in range(depth)), data[at]
            for i in range(8):
                yield context, byte >> (8 - i), i, (byte >> (7 - i)) & 1

    for t in texts[:5]:
        for context, prefix, i, bit in places(t):
            for d in range(depth + 1):
                (ones if bit else zeros)[context[:d], i, prefix] += 1
                if d < depth:
                    longer[context[:d], i, prefix].add(context[: d + 1])

    def estimate(node):
        a, b = ones[node], zeros[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        """(log weighted probability, share of the node's own estimate)"""
        own = estimate(node)
        if len(node[0]) == depth:
            return own, 1.0
        below = sum(weighted((c, *node[1:]))[0] for c in longer[node])
        return float(np.logaddexp(own, below)) - math.log(2), 1 / (1 + math.exp(below - own))

    for n, t in enumerate(texts):
        score = 0.0
        for context, prefix, i, bit in places(t):
            p = None
            for d in range(depth, -1, -1):
                node = (context[:d], i, prefix)
                if total := ones[node] + zeros[node]:
                    kt = ((ones if bit else zeros)[node] + 0.5) / (total + 1)
                    p = kt if p is None else (w := weighted(node)[1]) * kt + (1 - w) * p
            score += math.log10(0.5 if p is None else p)
        assert abs(got[n] - score) < 1e-9, (t, got[n], score)


def test_search_finds_the_nearest(spark):
    from variantloom.llm.ann import ann_search

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, None), (1501, [0.0] * 32), (1502, [float("nan")] * 32), (1503, x[0].tolist()), (None, x[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann_search(table, table.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    every = np.vstack([x, x[:1]]).astype(np.float64)
    ids = [*range(1500), 1503]
    hit = total = 0
    for q in range(0, 1500, 20):
        s = every @ every[q]
        best = [j for _, j in sorted((-s[k], i) for k, i in enumerate(ids) if i != q)[:20]]
        hit, total = hit + len(set(best) & set(got[q])), total + 20
        assert len(got[q]) == len(set(got[q])) == 20
    assert hit / total >= 0.9
    assert ann_search(table.limit(0), table, k=20).count() == 0


@pytest.mark.parametrize(("hashes", "kind"), [(1, "gauss"), (2, "gauss"), (2, "lengths"), (3, "clusters")])
def test_search_recall_at_any_number_of_hashes(spark, hashes, kind):
    """20,000 rows: Gaussian, of very unequal lengths, and clustered ones with a third of all rows in one spot."""
    from variantloom.llm.ann import ann_search

    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 32))
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(20_000, 1)))
        x[7] *= 500
    if kind == "clusters":
        x = rng.normal(size=(50, 32))[np.where(rng.random(20_000) < 0.33, 0, rng.integers(0, 50, 20_000))] * 3 + x * 0.5
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann_search(table, table.filter("vec_id % 400 = 0"), k=20, hashes=hashes).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 20_000, 400):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
        assert len(got[q]) == 20
    assert hit / (50 * 20) >= 0.9


def test_search_falls_back_to_every_row(spark):
    from variantloom.llm.ann import ann_search

    x = np.random.default_rng(4).normal(size=(12, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann_search(table, table.filter("vec_id = 3"), k=20, tables=1, probes=1).collect()
    s = x @ x[3]
    assert [r["vec_id"] for r in rows] == sorted((i for i in range(12) if i != 3), key=lambda i: -s[i]) and [r["rank"] for r in rows] == list(range(1, 12))


def test_hamming_search_is_exact(spark):
    from variantloom.llm.hamming import hamming_topk

    rng = random.Random(9)
    codes = {i: rng.getrandbits(63) for i in range(400)} | {i: 5 for i in range(400, 430)}
    table = spark.createDataFrame(list(codes.items()), "id long, code long")
    got = collections.defaultdict(list)
    for r in hamming_topk(table, table.filter("id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    for q in range(0, 430, 100):
        assert got[q] == sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:10]


def test_archives_round_trip(spark):
    import base64
    import hashlib

    from variantloom.llm.warc import archive_and_read_back

    rows = [(1, "http://a.example/x", "<p>é</p>"), (5, "http://B.example/", "same"), (3, "https://c.example:8080/y?z=1", "same"), (4, None, None), (6, "http://d.example/", ""), (7, "http://a.example/x", "long " * 5000)]
    got = {r["page_id"]: r for r in archive_and_read_back(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    payload = {i: (h or "").encode() for i, _, h in rows}
    for i, p in payload.items():
        first = min(j for j, q in payload.items() if q == p)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))


def test_index_lookups(spark):
    """Blocks of two lines and segments of a few: hits, misses, a key over several blocks, repeated rows, null ids and URLs, clashing columns."""
    from variantloom.llm.warc import archive_and_read_back, build_index, captures, lookup, write_archives

    urls = [f"http://h{i % 7}.example/p{i % 11}" for i in range(60)] + ["http://hot.example/"] * 30 + [None, "http://odd.example/a b", "http://odd.example/a\x01b", "http://odd.example/a"]
    rows = [(i if i % 13 else None, u, f"<p>{i % 50}</p>", "clash", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, key string, segment int")
    import tempfile

    root = tempfile.mkdtemp(prefix="warc-")
    write_archives(pages, f"{root}/archives", file_bytes=4000)
    build_index(captures(spark, f"{root}/archives"), f"{root}/index", block_lines=2, segment_lines=9)
    assert spark.read.parquet(f"{root}/index").count() > 40
    asked = spark.createDataFrame([("http://hot.example/",), ("https://HOT.example:443",), ("http://h3.example/p3",), ("http://nowhere.example/",), ("http://odd.example/a",), (None,)], "url string")
    got = collections.Counter(r["url"] for r in lookup(spark, f"{root}/index", asked).collect())
    want = collections.Counter((u or "") for _, u, *_ in rows + rows[:3] if u in ("http://hot.example/", "http://h3.example/p3", "http://odd.example/a", None))
    assert got == want
    back = archive_and_read_back(pages, block_lines=2, segment_lines=9).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"]) for r in back) == collections.Counter((i, len(h)) for i, _, h, *_ in rows + rows[:3])
    assert archive_and_read_back(pages.limit(0)).count() == 0


def test_language_model_on_held_out_text(spark, empty):
    from variantloom.llm.common import fold, read
    from variantloom.llm.langid import fit_language_model, predict_language

    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = fit_language_model(docs.filter(fold(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    found = predict_language(docs, model).join(docs, F.col("id") == F.col("doc_id")).filter((fold(F.col("doc_id"), 4) == 2) & (F.col("lang_pred") != "und") & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (3, "")], "doc_id long, text string")
    assert {r["lang_pred"] for r in predict_language(odd, model).collect()} == {"und"}
    assert predict_language(empty, fit_language_model(empty, "doc_id", "text", "lang")).count() == 0


def test_language_scores_are_the_windows_mean(spark):
    """Long, repeated and empty texts, null ids and clashing columns, beside the network applied to each window."""
    from variantloom.llm.langid import WINDOW, ByteCNN, language_of, predict_language, windows_of

    model = ByteCNN(["a", "b", "c"])
    texts = ["short text", "x" * 255 + "é" * 900, "word " * 4000, "same", "same", None, "!!"]
    rows = [(None if i == 3 else i, t, "clash", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")

    def plain(t):
        data = t.encode()
        parts = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
        p = (model.predict(windows_of(parts)) * np.array([[len(x)] for x in parts])).sum(axis=0) / len(data)
        return model.classes[int(p.argmax())], float(p.max())

    got = collections.Counter((r["id"], r["lang_pred"], round(r["score"], 5)) for r in predict_language(docs, model).collect())
    want = collections.Counter((i, *((c, round(p, 5)) if t and t != "!!" else ("und", 0.0))) for i, t, *_ in rows for c, p in [plain(t) if t else ("", 0.0)])
    assert got == want
    kept = language_of(docs, model)
    assert kept.columns == ["doc_id", "text", "score", "lang_pred", "lang_score"] and kept.count() == 7


def test_toxicity_sees_misspellings(spark, empty):
    from variantloom.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(2)
    clean = [f"c{i}lear{i % 7} meadow" for i in range(20)]
    rows = [(i, " ".join(rng.choices(clean, k=12) + (["horrible", "disgusting"] if i % 2 else [])), i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = [(1, " ".join(clean[:12])), (2, " ".join(clean[:12]) + " horrrible disgustingg"), (3, None), (4, ""), (5, "!!!")]
    got = {r["id"]: r["score"] for r in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[2] > 0.5 > got[1] and all(0 <= s <= 1 for s in got.values())
    assert score_toxicity(empty, model).count() == 0


def test_parity_pieces_meet_by_squares(monkeypatch):
    """A large piece, compared square by square, gives the pairs of one comparison; a forest stays below the number of nodes."""
    import numpy as np
    import pandas as pd

    from variantloom.llm import parity_join

    draw = np.random.default_rng(3)
    base = draw.integers(0, 256, (6, 128), dtype=np.uint8)
    rows = []
    for i in range(90):
        bits = base[i % 6].copy()
        bits[draw.integers(0, 128)] ^= 1 << int(draw.integers(0, 8))
        rows.append((7, i // 2 % 2, i, 100, i // 3, bits.tobytes(), [7] if i % 5 else [3, 7]))
    for p, q in ((0, 0), (0, 1)):
        pdf = pd.DataFrame([(r[0], p, q, *r[1:]) for r in rows if r[1] in (p, q)], columns=["key", "p", "q", "piece", "node", "size", "component", "sketch", "keys"])
        for forest in (True, False):
            found = []
            for square in (5, 1000):
                monkeypatch.setattr(parity_join, "SQUARE", square)
                found.append(set(parity_join._piecewise(75, forest)(pdf).itertuples(index=False, name=None)))
            assert found[0] == found[1] and found[0]
            assert not forest or len(found[0]) < len(pdf)
