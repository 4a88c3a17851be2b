"""Best-fit packing, token alignment and periodic runs against brute force, with odd rows."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from corvane.llm import alignment, best_fit, components, perfect_hash, periodic  # noqa: E402
from corvane.llm.queries import QUERIES  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, length string, start string, key string, runs string, groups string"


def texts():
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [None, "", " ", "\n\n", "one", "a b", "日本語 テキスト", "🙂 x\t y", "a" * 400, "x " * 300, "<|endoftext|> and <s> </s>", "under▁line", "\x00nul", "  two  spaces ", "tabs\t\t\nlines \n end", "é é Å   　"]
    out += [prose(r.randint(1, 400)) for _ in range(25)] + [prose(3000), prose(40) + " " + " ".join([prose(7)] * 9) + " " + prose(30)]
    out += [out[-1], out[-1], "a b a b a b a b c c c c c c d", "one one one one one", "one one one one one one"]
    return [(i, t) for i, t in enumerate(out)] + [(3, "\n\n"), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


# --- 11 ---

def check_packing(got, expected, length, documents=10**9, cost=10**18):
    """Pieces cover each row's ids, and every sequence keeps all limits without gaps."""
    sequences = collections.defaultdict(list)
    found = collections.Counter()
    for p in got:
        sequences[p["sequence_id"]].append(p)
        found[p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]] += 1
    assert found == expected
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own[:-1]]))
        assert sum(p["length"] for p in own) <= length and len(own) <= documents and sum(p["length"] ** 2 for p in own) <= cost
    return len(sequences)


def pieces_of(rows, length):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(BYTES), collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        ends = list(range(len(ids), 0, -length))[::-1]
        for k, end in enumerate(ends):
            a = ends[k - 1] if k else 0
            out[i, k, a, end - a, zlib.crc32(np.array(ids[a:end], dtype="<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize("pools", [None, 4])
def test_best_fit(docs, rows, measure, pools):
    got = best_fit.best_fit_documents(docs, BYTES, measure=measure, pools=pools).collect()
    n = check_packing(got, pieces_of(rows, 1024), 1024)
    bound = -(-sum(p["length"] for p in got) // 1024)
    assert bound <= n <= bound + 2 * (pools or 1)


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_under_every_limit(docs, rows, measure):
    got = best_fit.best_fit_documents(docs, BYTES, length=64, documents_limit=3, cost_limit=64 * 64, measure=measure, pools=1).collect()
    loose = best_fit.best_fit_documents(docs, BYTES, length=64, measure=measure, cost_limit=64 * 64, pools=1).collect()
    expected = pieces_of(rows, 64)
    assert check_packing(got, expected, 64, 3, 64 * 64) >= check_packing(loose, expected, 64)
    with pytest.raises(ValueError):
        best_fit.best_fit_documents(docs, BYTES, length=64, cost_limit=64)


@pytest.mark.parametrize("measure", sorted(best_fit.MEASURES))
@pytest.mark.parametrize("seed", range(6))
def test_measures_keep_limits_and_choose_as_defined(measure, seed):
    r = np.random.default_rng(seed)
    sizes = np.sort(r.integers(1, 100, 300))[::-1]
    limits, weights = np.array([120, 5, 10_000]), np.array([1.0, 0.5, 0.7])
    out = best_fit.MEASURES[measure](sizes, limits, weights)
    room: dict[int, np.ndarray] = {}
    need = best_fit.demands(sizes)
    for k in range(len(sizes)):
        if measure == "norm":
            fits = {b: (weights * ((x - need[k]) / limits) ** 2).sum() for b, x in room.items() if (x >= need[k]).all()}
            if fits:
                assert fits[out[k]] <= min(fits.values()) + 1e-12
            else:
                assert out[k] == len(room)
        room[int(out[k])] = room.get(int(out[k]), limits) - need[k]
    assert all((x >= 0).all() for x in room.values())
    if measure == "dot":  # no piece of a later sequence would have fitted
        assert all(not (need[out > b] <= x).all(axis=1).any() for b, x in room.items())


def test_best_fit_of_nothing(empty):
    assert best_fit.best_fit_documents(empty, BYTES).count() == 0


# --- 12 ---

def test_perfect_hash():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 40, 50_000))
    buckets = 7
    parts = []
    for b in range(buckets):
        sizes, words, ordered = perfect_hash.build(keys[perfect_hash.spread(keys) % buckets == b])
        parts.append((b, sizes, words.tobytes(), ordered.tobytes()))
    number = perfect_hash.PerfectHash.of(buckets, parts[::-1])
    assert sorted(number(keys)) == list(range(len(keys))) and (number.keys[number(keys)] == keys).all()
    strangers = np.setdiff1d(r.integers(0, 1 << 40, 50_000), keys)
    assert (number(strangers) == -1).all()
    nothing = perfect_hash.PerfectHash.of(0, [])
    assert len(nothing(np.zeros(0, dtype=np.int64))) == 0 and (nothing(keys[:3]) == -1).all()


def align_by_force(rows):
    """Each row's groups and links by walking over bytes."""
    import sentencepiece

    a, b = plain_tokenizer(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BYTES, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    symbols = alignment.byte_symbols()
    out = []
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        in_a, in_b = a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(symbols[c] for c in vocab[x]) for x in in_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in in_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((i, [], [], [], []))
            continue
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, ga, gb = [], [], []
        for p in range(len(whole)):
            ga += [owner_a[p]] if owner_a[p] not in ga else []
            gb += [owner_b[p]] if owner_b[p] not in gb else []
            if p + 1 == len(whole) or (owner_a[p] != owner_a[p + 1] and owner_b[p] != owner_b[p + 1]):
                groups.append(([in_a[k] for k in ga], [in_b[k] for k in gb]))
                ga, gb = [], []
        out.append((i, in_a, in_b, groups, [(in_a[x], in_b[y]) for x, y in links]))
    return out


@pytest.mark.parametrize("way", ["broadcast", "joined", "small"])
def test_alignment(docs, rows, way, monkeypatch):
    if way == "joined":
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 10)
    if way == "small":  # several buckets, blocks, and levels of the tree; sums handed on
        for name, value in (("BUCKET", 64), ("BLOCK", 16), ("FAN", 2), ("TOGETHER", 500)):
            monkeypatch.setattr(alignment, name, value)
    forced = align_by_force(rows)
    counts = collections.Counter(x for row in forced for x in row[4])
    top: dict = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    join = lambda ids: ",".join(map(str, ids))
    expected = collections.Counter(
        (i, len(a), len(b), len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), ";".join(f"{join(p)}|{join(q)}" for p, q in g)) for i, a, b, g, k in forced
    )
    got = alignment.align_documents(docs, BYTES, PIECES).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert collections.Counter(map(tuple, got)) == expected
    assert sum(1 for x in expected if x[1]) > 30 and any(not x[1] and x[0] == 11 for x in expected)


def test_alignment_of_nothing(empty, spark):
    assert alignment.align_documents(empty, BYTES, PIECES).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align_documents(blank, BYTES, PIECES).select("doc_id", "n_a", "n_links", "n_best", "count_sum", "groups").collect()] == [(0, 0, 0, 0, "")] * 2


# --- 13 ---

def runs_by_force(w, exponent=4, least=6):
    n, out = len(w), []
    for d in range(1, n // exponent + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and w[j] == w[j + d]:
                j += 1
            length = j - i + d
            if j > i and length >= max(least, exponent * d):
                s = w[i : i + length]
                if not any(s[e:] == s[:-e] for e in range(1, d)):
                    out.append((i, length, d))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("pattern", [1, 4, 4096])
def test_runs_by_force(pattern, monkeypatch):
    monkeypatch.setattr(periodic, "PATTERN", pattern)
    r = random.Random(pattern)
    for _ in range(300):
        k, w = r.randint(1, 4), []
        for _ in range(r.randint(0, 6)):
            u = [r.randint(0, k) for _ in range(r.randint(1, r.choice([2, 5, 20, 40])))]
            w += u * r.randint(1, 9) + u[: r.randint(0, len(u))]
        assert periodic.periodic_runs(np.array(w, dtype=np.int64)) == runs_by_force(w)
        assert periodic.periodic_runs(np.array(w, dtype=np.int64), exponent=5, least=12) == runs_by_force(w, 5, 12)
    with pytest.raises(ValueError):
        periodic.periodic_runs(np.zeros(9, dtype=np.int64), exponent=3)


@pytest.mark.parametrize("size", [2, 8, 128])
def test_transform_is_exact(size):
    r = np.random.default_rng(size)
    x = r.integers(0, periodic.PRIME, (5, size))
    assert (periodic.restored(periodic.transform(x)) == x).all()
    b = size // 2
    top = int(np.sqrt((periodic.PRIME - 1) // b))
    blocks, windows = r.integers(0, top + 1, (5, b)), r.integers(0, top + 1, (5, 2 * b - 1))
    blocks[0], windows[0] = 0, top  # the largest sum
    windows[1, b - 1 :] = blocks[1]
    got = periodic.mismatches(blocks, windows)
    assert (got == [[((p - w[k : k + b]) ** 2).sum() for k in range(b)] for p, w in zip(blocks, windows, strict=True)]).all() and got[1, b - 1] == 0


def test_long_runs_are_found_once():
    assert periodic.periodic_runs(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]
    assert periodic.periodic_runs(np.tile(np.arange(9_000), 6)) == [(0, 54_000, 9_000)]


def collapsed(words, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_periodic_runs_of_documents(docs, rows, empty):
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.find_runs(docs).collect())
    expected = collections.Counter()
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = runs_by_force(words)
        expected[i, len(words), tuple(found), collapsed(words, found)] += 1
    assert got == expected and sum(len(x[2]) for x in expected) >= 7
    assert periodic.find_runs(empty).count() == 0


def test_query_of_periodic_runs(spark, data):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, data).collect()}
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    changed = 0
    for i, text in texts:
        w = [x.decode() for x in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            changed += 1
        runs = runs_by_force(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(w, runs)))
        assert tuple(got[i]) == want
    assert changed > 5 and len(got) == len(texts)


def test_looped_texts_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (10, None), (11, ""), *[(k, " x \n y z  w ") for k in range(40)]], "doc_id long, text string")
    got = df.select("doc_id", "text", periodic.looped(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert got[0]["new"] == "a b c" and not got[1]["new"] and got[2]["new"] == ""
    for i, text, new in got[3:]:
        h = zlib.crc32(str(i).encode())
        assert new == text if h % 10 else new.split()[: (h // 10) % 4] == ["x", "y", "z", "w"][: (h // 10) % 4]


# --- components ---

def test_components_by_force(spark):
    r = random.Random(12)
    links, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g in range(40):  # paths, stars, rings and loose graphs, each with ids of its own
        ids = r.sample(range(1000 * g, 1000 * g + 1000), r.randint(2, 40))
        kind = g % 4
        pairs = list(zip(ids, ids[1:], strict=False)) if kind in (0, 3) else [(ids[0], x) for x in ids[1:]] if kind == 1 else [tuple(r.sample(ids, 2)) for _ in ids]
        links += pairs + ([(ids[-1], ids[0])] if kind == 3 else []) + [(ids[0], ids[0])]
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
