"""Each operator against brute force: on rows with every kind of edge, on an empty table, and on a small table of documents."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, decontaminate, jaccard, kernels, language, quality, sharding
from ledgerlens.llm.jaccard import jaccard_groups
from ledgerlens.llm.lines import removed_lines
from ledgerlens.llm.mixing import MIX_SQL, mix, mixed
from ledgerlens.llm import substrings
from ledgerlens.llm.repeats import Repeats, words_of
from ledgerlens.llm.substrings import removed_bytes, removed_words
from ledgerlens.llm.tokens import _AGREED, PATTERN, token_counts
from tests.llm import brute
from tests.llm.conftest import plain


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def with_ids(pairs, results):
    return plain((d, *r) for (d, _), r in zip(pairs, results, strict=True))


# 1


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@pytest.mark.parametrize("frequent", [0, 5, 10**6])
def test_token_counts(spark, edge, edge_pairs, bpe, frequent):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(bpe).encode_batch([t or "" for _, t in edge_pairs], add_special_tokens=False)
    want = [(len((t or "").encode()), len(x.ids), len(x.ids) > 1024) for (_, t), x in zip(edge_pairs, ids, strict=True)]
    assert plain(token_counts(spark, edge, bpe, frequent=frequent).collect()) == with_ids(edge_pairs, want)


def test_token_counts_of_nothing(spark, empty, bpe):
    assert token_counts(spark, empty, bpe).collect() == []


def test_pattern_agrees_with_the_library_where_it_is_used(bpe):
    import regex
    from tokenizers import Tokenizer

    cutter, pattern = Tokenizer.from_file(bpe).pre_tokenizer, regex.compile(PATTERN)
    for code in [*range(0x600), *range(0x2000, 0x2100)]:
        text = f"a{chr(code)}1 {chr(code)}{chr(code)} b"
        if not _AGREED.search(text):
            assert [s for _, s in cutter.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)], hex(code)


# 2


def test_lines(spark, edge, edge_pairs, docs, pairs, empty):
    assert plain(removed_lines(spark, edge).collect()) == plain(brute.removed_lines(edge_pairs))
    assert plain(removed_lines(spark, docs, 2).collect()) == plain(brute.removed_lines(pairs, 2))
    assert removed_lines(spark, empty).collect() == []


# 3


def test_wand_finds_all_over_the_threshold(spark, small, pairs):
    index = next(decontaminate.indexes(spark.read.parquet(f"{small}/benchmark.parquet")))
    found = 0
    for _, text in pairs[:120]:
        query = sorted(set(decontaminate.terms(pa.array([text]))[0].tolist()))
        scores = defaultdict(float)
        for t in query:
            for i, s in zip(*index.postings.get(t, ((), ())), strict=True):
                scores[i] += s
        for least in (0.1, 0.3, 0.6):
            want = {i for i, s in scores.items() if s >= least - 1e-9}
            assert {i for i, _ in index.search(query, least)} == want
            found += len(want)
    assert found > 100


def test_leaks(spark, small, docs, pairs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = {(d, i.item_id) for i in items.collect() for d, t in pairs if i.text in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, items).collect()} == want and want
    kept = {r.doc_id for r in decontaminate.without_leaks(spark, docs, items).collect()}
    assert kept == {d for d, _ in pairs} - {d for d, _ in want}


def test_leaks_at_every_place_and_in_blocks_of_items(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"q{k}x{rng.randrange(900)}" for _ in range(12 + k))) for k in range(9)]
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    docs = [(at, noise(at) + " " + items[at % 9][1].upper().replace(" ", ", ") + " " + noise(30)) for at in range(60)] + [(99, noise(200)), (98, None), (None, items[0][1])]
    texts, docs = docs, spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    rows = decontaminate.leaks(spark, docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(at, at % 9) for at in range(60)} | {(None, 0)}
    blocks = list(decontaminate.indexes(table, 300))
    assert len(blocks) > 1 and {b.longest for b in blocks} == {20}
    found = set()
    for b in blocks:  # as many rows from blocks as from the whole index
        for d, t in texts:
            found |= {(d, b.ids[r[1]], *r[2:]) for r in b.leaks(pa.array([t], pa.string()))}
    assert found == {tuple(r) for r in rows}


def test_leaks_of_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    assert decontaminate.leaks(spark, edge, items).collect() == [] and decontaminate.leaks(spark, edge, items.limit(0)).collect() == []
    assert decontaminate.leaks(spark, empty, items).collect() == []
    assert plain(decontaminate.without_leaks(spark, edge, items).collect()) == plain(edge.collect())


# 4


def test_mix(spark, edge, edge_pairs, docs, empty):
    rows = mix(spark, edge).collect()
    assert plain((r.doc_id, r.size) for r in rows) == with_ids(edge_pairs, [(len(brute.words(t)),) for _, t in edge_pairs])
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in rows)
    assert plain(rows) == plain(mix(spark, edge).collect()) and mix(spark, empty).collect() == []
    assert mixed(edge).count() == sum(r.copies for r in rows) and mixed(edge).columns == edge.columns


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), None if i % 11 == 0 else f"s{i % 7}") for i in range(9000)]
    out = mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("t", F.round("target", 3))
    taken = out.groupBy("source_size", "t").agg(F.sum("taken").alias("k")).collect()
    sizes = sum(r.source_size for r in taken)
    assert len(taken) == 8 and abs(sum(r.t for r in taken) - 1.5 * sizes) < 1
    assert all(r.t <= 2 * r.source_size + 1e-6 and abs(r.k - r.t) < 0.01 * r.t + 50 for r in taken)


def test_mix_equals_sql(spark, small):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = mix(spark, spark.read.parquet(f"{small}/documents.parquet")).collect()
    found = sorted((tuple(r[c] for c in ("doc_id", "size", "copies", "taken")) for r in got))
    assert found == sorted(c.execute(f"SELECT doc_id, size, copies, taken FROM ({MIX_SQL})").fetchall())


# 5, 9


def test_repeated_words(spark, edge, edge_pairs, docs, pairs, empty):
    assert plain(removed_words(spark, edge).collect()) == with_ids(edge_pairs, brute.removed_words([t for _, t in edge_pairs]))
    assert plain(removed_words(spark, docs).collect()) == with_ids(pairs, brute.removed_words([t for _, t in pairs]))
    assert removed_words(spark, empty).collect() == []


def test_repeated_bytes(spark, edge, edge_pairs, docs, pairs, empty):
    assert plain(removed_bytes(spark, edge).collect()) == with_ids(edge_pairs, brute.removed_bytes([t for _, t in edge_pairs]))
    assert plain(removed_bytes(spark, docs).collect()) == with_ids(pairs, brute.removed_bytes([t for _, t in pairs]))
    assert removed_bytes(spark, empty).collect() == []


def test_anchors_of_texts_longer_than_a_piece():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    h[1000:1100] = h[1000]
    for w in (1, 7, 18, 64):
        whole = kernels.sliding_argmin(h, w)
        assert [int(x) for x in whole] == [i + int(np.argmin(h[i : i + w] >> np.uint64(28))) for i in range(5000 - w + 1)]
        assert (kernels.sliding_argmin(h, w, 100) == whole).all() and len(kernels.sliding_argmin(h[: w - 1], w)) == 0


def test_sketch_overestimates_and_little(spark):
    """Cells add up to no less than the counts, and few of the names that occur once come under suspicion."""
    rng = np.random.default_rng(2)
    names = rng.integers(-(2**63), 2**63, 40_000)
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate([names, names[:500], names[:20]])], "name long").repartition(5)
    bits = (40_520 * substrings.CELLS - 1).bit_length()
    often = substrings.merged(substrings.sketched(rows, bits)).collect()
    n = {(r.row, r.cell): r.n for r in often}
    cells = lambda x: [int(x) & ((1 << bits) - 1), (int(x) & (2**64 - 1)) >> (64 - bits)]
    estimate = [min(n.get((row, c), 1) for row, c in enumerate(cells(x))) for x in names]
    assert all(e >= (3 if i < 20 else 2) for i, e in enumerate(estimate[:500]))
    assert sum(e > 1 for e in estimate[500:]) < 0.02 * len(names)
    with pytest.raises(ValueError):
        Repeats(words_of, 600, 301)


# 6


def test_jaccard_groups(spark, edge, edge_pairs, docs, pairs, empty):
    assert plain(jaccard_groups(spark, edge).collect()) == plain(brute.groups(*zip(*edge_pairs, strict=True))[0])
    assert plain(jaccard_groups(spark, docs).collect()) == plain(brute.groups(*zip(*pairs, strict=True))[0])
    assert jaccard_groups(spark, empty).collect() == []


@pytest.mark.parametrize("leaf, whole", [(jaccard.LEAF, jaccard.WHOLE), (3, 0)])
def test_jaccard_groups_of_many_unlike_texts_around_one_passage(spark, monkeypatch, leaf, whole):
    """Joined whole, and by Voronoi regions down to three documents."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "WHOLE", whole)
    rng = random.Random(2)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(16)):
            w[rng.randrange(200)] = f"z{rng.randrange(7)}"
        rows.append((i, " ".join(w)))
        rows.append((100 + i, " ".join([f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + base[:40])))
    got = jaccard_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert plain(got) == plain(brute.groups(*zip(*rows, strict=True))[0])


def test_jaccard_groups_leave_no_work_on_disk_and_may_compare_in_many_rounds(spark, docs, pairs, monkeypatch, tmp_path):
    """Tables of texts, n-grams and regions are emptied when they have been read; pairs that are sent in many rounds give the same links."""
    monkeypatch.setattr(jaccard, "ROUND", 0.2)
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    dealt, rounds = jaccard.dealt, []
    monkeypatch.setattr(jaccard, "dealt", lambda *a: rounds.append(dealt(*a)) or rounds[-1])
    few = [p for p in pairs if p[0] < 120]
    got = plain(jaccard_groups(spark, docs.filter("doc_id < 120")).collect())
    assert got == plain(brute.groups(*zip(*few, strict=True))[0])
    assert max(map(len, rounds)) > 1
    left = {d.name: sum(f.stat().st_size for f in d.glob("*.parquet")) for d in tmp_path.iterdir()}
    assert all(size < 1000 for name, size in left.items() if name.startswith(("grams_", "early", "star-early", "star-sets"))), left


def test_comparing_many_near_copies_sends_one_text_of_a_pair_in_bounded_parts(spark, monkeypatch):
    """A text that is in all pairs is sent to the others; the n-grams on disk at a time are those of one part of the pairs."""
    rng = random.Random(6)
    texts = {}
    for i in range(6):
        base = [f"b{rng.randrange(10**6)}" for _ in range(40)]
        texts |= {10 * i + j: " ".join([*base[: 38 - j], f"z{i}{j}", *base[38 - j :]]) for j in range(4)} | {10 * i + 9: "short text"}
    sets = {k: set(jaccard.grams(pa.array([t]))[0].view("int64").tolist()) for k, t in texts.items()}
    rows = [(min(10 * i + 2, k), max(10 * i + 2, k), len(sets[10 * i + 2]) + len(sets[k])) for i in range(6) for k in (10 * i, 10 * i + 1, 10 * i + 3, 10 * i + 9)]
    sizes, cut = [], jaccard.cut

    def seen(spark, df, name):
        out = cut(spark, df, name)
        if name.endswith("-sets"):
            sizes.append(out.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(jaccard, "cut", seen)
    of = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = jaccard.compared(spark, of, spark.createDataFrame(rows, "a long, b long, total int"), None, sum(r[2] for r in rows) // 3, "few", exact=True).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, len(sets[a] & sets[b]), n) for a, b, n in rows)
    assert len(sizes) > 1 and sum(sizes) <= sum(len(sets[10 * i + 2]) for i in range(6)), sizes


def test_sampled_ngrams_that_every_task_has_once_are_known_as_frequent(spark):
    """A passage of many texts, but of one in each task: no task sees it often, the sample does."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"r{rng.randrange(10**6)}" for _ in range(9)] + [f"p{j}" for j in range(60)])) for i in range(96)]
    texts = spark.createDataFrame(rows, "key long, text string").repartition(96, "key")
    known, count = jaccard.frequent_grams(spark, texts)
    passage = jaccard.grams(pa.array([" ".join(f"p{j}" for j in range(60))]))[0]
    low = passage[passage < jaccard.K.U(jaccard.LOW * 2**64)]
    assert len(low) and set(low.tolist()) <= set(known.tolist())


def test_voronoi_regions_part_clusters_and_lose_no_link(spark):
    """Points on a line as distances: of two clusters each goes to its own pivot, a point between stands in both."""
    at = {k: x for k, x in enumerate([0.0, 0.05, 0.1, 0.2, 0.45, 0.9, 0.95, 1.0, 0.85, 0.8])}
    rows = spark.createDataFrame([(1, k, 9, 0, 99, 2) for k in at], "g long, key long, n int, place int, p long, pivots int")
    chosen = spark.createDataFrame([(1, 0, 1), (1, 7, 2)], "g long, pivot long, rank int")
    shared = lambda a, b: round(1000 * (1 - abs(at[a] - at[b])))
    known = spark.createDataFrame([(min(a, b), max(a, b), shared(a, b), 1000 + shared(a, b)) for a in (0, 7) for b in at if a != b], "a long, b long, common int, total int")
    cells = defaultdict(set)
    for r in jaccard.voronoi(rows, chosen, known).collect():
        cells[r.g].add(r.key)
    assert sorted(map(sorted, cells.values())) == [[1, 2, 3, 4], [5, 6, 8, 9]]
    for x in at:
        for y in at:
            if x < y and abs(at[x] - at[y]) <= jaccard.FAR and not {x, y} & {0, 7}:
                assert any({x, y} <= c for c in cells.values())


def test_jaccard_groups_with_keys_that_agree_by_chance(spark, docs, pairs, monkeypatch):
    """Keys of few bits: different texts with equal ones are told apart by their digests."""
    monkeypatch.setattr(common, "text_key", lambda text: F.pmod(F.xxhash64(text), F.lit(97)))
    some = docs.filter("doc_id < 120")
    few = [p for p in pairs if p[0] < 120]
    assert plain(jaccard_groups(spark, some).collect()) == plain(brute.groups(*zip(*few, strict=True))[0])
    assert plain(removed_words(spark, some).collect()) == with_ids(few, brute.removed_words([t for _, t in few]))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_met_in_pieces(spark, how):
    """A third of all rows have one key; the join's rows are those of a plain join."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    table = common.cut(spark, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v")).filter("k % 5 <> 1"), "table")
    want = rows.join(table.drop("n"), ["k"], how)
    assert plain(common.meet(rows, table, ["k"], how).collect()) == plain(want.collect())


# 7


def least_capacity(weights, shards):
    best = [0] + [float("inf")] * len(weights)
    sums = np.concatenate([[0], np.cumsum(weights)])
    for _ in range(shards):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i)) for i in range(1, len(weights) + 1)]
    return best[-1]


def test_capacity_is_the_least():
    rng = random.Random(4)
    for _ in range(60):
        weights = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 30))]
        n = rng.randrange(1, 8)
        capacity = sharding.least_capacity(weights, n)
        assert capacity == least_capacity(weights, n)
        ends = sharding.balanced_cuts(weights, n, capacity)
        parts = [sum(weights[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        assert ends[-1] == len(weights) and max(parts) <= capacity


def test_cuts_by_zooming_equal_cuts_of_single_groups(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.randrange(1 << sharding.KEY_BITS), rng.randrange(1, 500)) for _ in range(3000)]
    groups = spark.createDataFrame(rows, "key long, bytes long").cache()
    weights = [w for _, w in sorted(rows)]
    monkeypatch.setattr(sharding, "RANGES", 64)
    ends, keys = sharding.cuts(groups, 12), [k for k, _ in sorted(rows)]
    at = [0, *[keys.index(e) + 1 for _, e in ends]]
    assert at[-1] == len(rows) and max(sum(weights[a:b]) for a, b in zip(at, at[1:], strict=False)) == sharding.least_capacity(weights, 12)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards(spark, edge, edge_pairs, docs, shards):
    import zlib

    for df, known in ((edge, edge_pairs), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        rows = sharding.shard(spark, df, shards).collect()
        want = [(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in known]
        assert plain((r.doc_id, r.size, r.text_crc32) for r in rows) == with_ids(known, want)
        places, homes = defaultdict(list), defaultdict(set)
        for r in rows:
            places[r.shard].append(r.slot)
            homes[r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in places.values()) and all(0 <= k < shards for k in places)
        assert all(len(s) == 1 for s in homes.values())


def test_cuts_of_heavy_tailed_groups(spark):
    """Hundreds of groups of a good share of a shard among small ones, at the real number of ranges."""
    rng = random.Random(9)
    rows = {rng.randrange(1 << sharding.KEY_BITS): rng.randrange(1, 400) for _ in range(150_000)}
    for key in rng.sample(sorted(rows), 700):
        rows[key] = int(400 * rng.paretovariate(0.7)) % 600_000
    large = sorted(((k, w) for k, w in rows.items() if w > 400_000), key=lambda r: (-r[1], r[0]))[:9]
    rest = sorted(set(rows.items()) - set(large))
    ends = sharding.cuts(spark.createDataFrame(rest, "key long, bytes long").cache(), 40, large)
    order = [*large, *rest]
    places = {(0, i): i for i in range(len(large))} | {(1, k): len(large) + i for i, (k, _) in enumerate(rest)}
    at = [0, *[places[e] + 1 for e in ends]]
    parts = [sum(w for _, w in order[a:b]) for a, b in zip(at, at[1:], strict=False)]
    assert at[-1] == len(order) and max(parts) == sharding.least_capacity([w for _, w in order], 40) and min(parts) > 0


def test_shards_with_groups_over_a_fair_share_are_minimax(spark):
    rng = random.Random(12)
    for shards in (3, 7):
        sizes = [5000, 900, 800, *[rng.randrange(0, 200) for _ in range(40)]]
        rows = [(i, chr(97 + i % 26) * (n - n // 3) + str(i)) for i, n in enumerate(sizes) for _ in range(1 + i % 3)]
        out = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        total, groups = defaultdict(int), defaultdict(int)
        for r in out:
            total[r.shard] += r.size
            groups[r.doc_id] += r.size
        import hashlib

        text = dict(rows)
        order, left, k = [], sum(groups.values()), 0
        for d in sorted(groups, key=lambda d: -groups[d])[: shards - 1]:
            if groups[d] * (shards - k) <= left:
                break
            order, left, k = [*order, d], left - groups[d], k + 1
        order += sorted(set(groups) - set(order), key=lambda d: hashlib.sha256(text[d].encode()).hexdigest())
        assert max(total.values()) == least_capacity([groups[d] for d in order], shards)


def test_shards_of_nothing(spark, empty):
    assert sharding.shard(spark, empty).collect() == []


# 8


def test_gradients():
    model = language.BiGRU(["a", "b"])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    chars = np.zeros((2, language.SPAN), np.uint8)
    chars[0, :3], chars[1, :2] = (97, 98, 99), (100, 101)
    given = chars, np.array([3, 2]), np.array([0, 1])
    _, grads = model.gradients(*given)
    for k, i in (("xf", (98, 3)), ("xf", (97, 40)), ("uf", (2, 20)), ("o", (3, 1)), ("cb", (5,)), ("cf", (35,))):
        model.w[k][i] += 1e-3
        up, _ = model.gradients(*given)
        model.w[k][i] -= 2e-3
        down, _ = model.gradients(*given)
        model.w[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][i]) < 1e-5


def test_language(spark, docs):
    out = docs.join(language.languages(spark, docs), "doc_id").cache()
    assert out.filter("held_out").count() > 30
    assert out.filter("held_out and lang = lang_pred").count() >= 0.97 * out.filter("held_out").count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_labels_and_pooling_against_a_loop(edge_pairs):
    """Every position's probabilities by the formulas of a gated recurrent network, one number after the other."""
    model = language.BiGRU(["a", "b"], seed=3)
    h, w = language.HIDDEN, {k: v.astype(np.float64) for k, v in model.w.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(read, d):
        out, s = [], np.zeros(h)
        for byte in read:
            x, u = w["x" + d][byte] + w["c" + d], s @ w["u" + d]
            z, r = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
            n = np.tanh(x[2 * h :] + r * u[2 * h :])
            s = (1 - z) * n + z * s
            out.append(s)
        return out

    texts = [t for d, t in edge_pairs if d != 14]
    pred, score, none = language.Labeller(model)(pa.array(texts), pa.array([bool(t) and any(c.isalpha() for c in t) for t in texts]))
    for t, p, sc, no in zip(texts, pred, score, none, strict=True):
        read = bytearray()
        for byte in (t or "").encode():
            letter = byte >= 128 or chr(byte).isalpha()
            if letter or read and read[-1] != 32:
                read.append(ord(chr(byte).lower()) if letter and byte < 128 else byte if letter else 32)
        total, count = np.zeros(3), 0
        for at in range(0, len(read), language.SPAN):
            part = read[at : at + language.SPAN]
            for byte, f, b in zip(part, states(part, "f"), states(part[::-1], "b")[::-1], strict=True):
                if byte != 32:
                    e = np.exp(np.concatenate([f, b]) @ w["o"] + w["p"])
                    total, count = total + e / e.sum(), count + 1
        if p == "und":
            assert not (t and any(c.isalpha() for c in t)) and sc == 0 and no == 1
        else:
            assert p == "ab"[int(total[:2].argmax())] and abs(sc - total[:2].max() / count) < 1e-3
            assert abs(no - total[2] / (count + language.PRIOR)) < 1e-3


def test_all_languages_can_be_predicted_and_noise_is_rejected(spark, docs):
    """More languages than the bound on documents, and texts that are letters without any language."""
    rng = random.Random(6)
    made = lambda n: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 4))) for _ in range(n))
    rows = []
    for k in range(70):
        s = [a + b for a in rng.sample("bcdfghklmnprstvz", 3) for b in rng.sample("aeiou", 2)]
        rows += [(k * 10 + i, made(60), f"l{k}", None, None) for i in range(6)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit(few, most=30)
    assert model.langs == sorted(f"l{k}" for k in range(70))
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)), "x" * 500, "".join(chr(rng.randrange(0x430, 0x450)) for _ in range(200)), "123 456 ...", None]
    odd = spark.createDataFrame([(-1 - i, t, None, "s", 1) for i, t in enumerate(noise)], docs.schema)
    mixed_ = docs.filter("lang = 'en'").limit(5).collect() + docs.filter("lang = 'fr'").limit(5).collect()
    both = spark.createDataFrame([(-100 - i, a.text + "\n" + b.text, None, "s", 1) for i, (a, b) in enumerate(zip(mixed_[:5], mixed_[5:], strict=True))], docs.schema)
    out = language.accepted(spark, docs.unionByName(odd).unionByName(both)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} | {r.doc_id for r in both.collect()}
    assert all(r.lang in {"en", "fr"} for r in out if r.doc_id <= -100)


def test_language_of_edges(spark, edge, empty):
    rows = language.languages(spark, edge).collect()
    none = {7, 8, 9, 13}
    assert len(rows) == edge.count() and all((r.lang_pred == "und") == (r.doc_id in none) for r in rows if r.doc_id != 13 or r.lang_pred == "und")
    assert all(r.lang_pred in {"en", "fr", "und"} for r in rows)
    assert language.languages(spark, empty).collect() == []
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.languages(spark, unlabelled).collect()} == {"und"}


# 10


def test_quality(spark, edge, edge_pairs, docs, pairs, empty):
    for df, known in ((edge, edge_pairs), (docs, pairs)):
        rows = quality.quality(spark, df).collect()
        want = []
        for _, t in known:
            n, *rest, repeated = brute.counts(t)
            want.append((n, *rest, repeated, n < 10 or 100 * repeated > 20 * n))
        assert plain(tuple(r)[:7] for r in rows) == with_ids(known, want)
        assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in rows)
    assert quality.quality(spark, empty).collect() == []


def test_estimates_find_the_documents_that_rules_agree_on():
    good, bad = (1,) * 6, (1, -1, -1, 1, 1, 1)
    prior, prob = quality.fit([(good, 900), (bad, 60), ((1, 1, 1, 1, 0, 1), 40)])
    assert quality.posterior(good, prior, prob) > 0.9 > 0.1 > quality.posterior(bad, prior, prob)
