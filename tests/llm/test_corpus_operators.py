"""Operators across documents: SimHash groups, repeated strings, mixing, sharding, the pipeline."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from helpers import awkward, awkward_rows, plain, prose
from pyspark.sql import functions as F

from thermocline.llm import common, mixing, sharding, simhash, suffixes


# ---- SimHash ----


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits=2):
    """fps: (key, fingerprint) rows; the smallest key reachable."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return {(k, f): least.get(find(f)) for k, f in fps}


def test_golay_tables():
    tables = simhash.golay_tables()
    assert Counter(tables[1].tolist()) == {1: 277, 6: 1771}
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 20_000)
    y = x ^ (1 << r.integers(0, 23, len(x)))
    near, every = simhash.golay_keys(x, tables)
    other, _ = simhash.golay_keys(y, tables)
    assert (every == other[:, None]).any(1).all() and (every[:, 0] == near).all()
    words = (near << 11) | simhash.syndrome(near << 11)  # codewords have no syndrome and lie within three bits
    assert not simhash.syndrome(words).any() and np.bitwise_count(words ^ x).max() == 3


@pytest.mark.parametrize(("hot_key", "part"), [(5_000, 50_000), (2, 4)])
def test_links_find_every_pair_within_two_bits(spark, monkeypatch, hot_key, part):
    monkeypatch.setattr(simhash, "HOT_KEY", hot_key)
    monkeypatch.setattr(simhash, "PART_PROBES", part)
    r = np.random.default_rng(4)
    base = r.integers(-(1 << 63), 1 << 63, 60)
    fps = set(base.tolist())
    for f in base.tolist():
        for n in (1, 2, 2, 2, 3):
            flip = sum(1 << int(b) for b in r.choice(64, n, replace=False))
            x = (f ^ flip) & ((1 << 64) - 1)
            fps.add(x - (1 << 64) if x >> 63 else x)
    every = sorted(fps)
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(f,) for f in every], "_fp long")).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(want) > 200 and len(got) == len(want)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "_fp long"), 3)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 500)] + [(1, 2), (2, 3), (1, 3)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{j: 7 for j in range(200, 500)}, 2: 1, 3: 1}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rows = list(awkward_rows())
    for i in range(12):  # long texts with a few words changed
        words = prose(i % 3, 400).split(" ")
        for j in range(i):
            words[(j * 37 + i) % 400] = f"new{i}"
        rows.append((50 + i, " ".join(words), "s"))
    fps = [(k, brute_fingerprint(t)) for k, t, _ in rows]
    want = brute_components(fps)
    got = simhash.near_duplicates(plain(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((k, f"{f:016x}", want[k, f]) for k, f in fps)


def test_deduplicate_keeps_one_of_each_group(spark):
    df = awkward(spark)
    rows = [(k, t) for k, t, _ in awkward_rows()]
    want = brute_components([(k, brute_fingerprint(t)) for k, t in rows])
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = Counter((want[k, brute_fingerprint(t)], None if want[k, brute_fingerprint(t)] is not None else brute_fingerprint(t)) for k, t in texts)
    assert set(groups.values()) == {1} and len(groups) == len({(want[k, brute_fingerprint(t)], None if want[k, brute_fingerprint(t)] is not None else brute_fingerprint(t)) for k, t in rows})
    assert all(k == want[k, brute_fingerprint(t)] for k, t in texts)
    assert simhash.deduplicate(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


# ---- repeated strings ----


def brute_repeats(rows, n=suffixes.LENGTH):
    first = {}
    texts = [(-1 if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in texts:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(k, first.get(b[p : p + n], k))
    out = []
    for k, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < k:
                gone[p : p + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if k == -1 else k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("hot_docs", "block"), [(20_000, 4 << 20), (2, 700)])
def test_repeats_against_brute_force(spark, monkeypatch, hot_docs, block):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "STEP", 500)
    passage = prose(77, 30)
    rows = [(k, t) for k, t, _ in awkward_rows()]
    rows += [(20 + i, prose(i, 25) + passage[i : 60 + 3 * i] + prose(90 + i, 12)) for i in range(12)]
    rows += [(40, "a" * 300), (41, "a" * 120), (42, "ab" * 100), (43, "b" + "a" * 49 + "c"), (44, passage), (45, passage), (46, "\x00" * 80), (47, "\x00" * 60 + "z")]
    got = suffixes.remove_repeats(plain(spark, [(k, t, "") for k, t in rows], parts=4), hot_docs=hot_docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows)
    assert all(sum(z - a + 1 for a, z in zip(r["firsts"], r["lasts"], strict=True)) == r["n_removed"] for r in got)


def test_repeats_of_an_empty_table(spark):
    assert suffixes.remove_repeats(awkward(spark).limit(0)).count() == 0


def test_multikey_sort_and_anchors():
    r = np.random.default_rng(2)
    rows = r.integers(0, 3, (500, 19)).astype(np.uint8)
    rows[100:140] = rows[0]
    order, common = suffixes.multikey_sort(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(texts)
    assert all(a[:n] == b[:n] and (n == 19 or a[n] != b[n]) for a, b, n in zip(texts, texts[1:], common[1:].tolist(), strict=False))
    data = r.integers(0, 2, 4000).astype(np.uint8)
    data[2000:2100] = data[100:200]
    at, low, high, gram = suffixes.anchors(data, np.array([1500, 4000]))
    windows = [p for a, lo, hi in zip(at, low, high, strict=True) for p in range(a - hi, a - lo + 1)]
    assert sorted(windows) == [p for p in range(4000 - 49) if not 1451 <= p < 1500]
    of = {p: (a - p) for a, lo, hi in zip(at, low, high, strict=True) for p in range(a - hi, a - lo + 1)}
    assert all(of[100 + i] == of[2000 + i] for i in range(51))  # equal windows have equal anchors
    hashes = suffixes.gram_hashes(data)
    assert len(hashes) == 4000 - 23 and hashes[100] == hashes[2000]


# ---- ranks, sharding, mixing ----


@pytest.mark.parametrize("rows_per_cell", [3, 1000])
def test_ranks_over_cells(spark, rows_per_cell):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    got = common.rank_within(df, "g", "h", ["id"], rows_per_cell).collect()
    assert len(got) == 200
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in mine] == list(range(len(mine))) and {r["_size"] for r in mine} == {len(mine)}
        hashes = [r["h"] % (1 << 64) for r in mine] if rows_per_cell == 3 else [r["h"] for r in mine]
        assert rows_per_cell == 3 or hashes == sorted(hashes)
    frac = spark.range(100).select("id", (F.pmod(F.col("id") * 37, F.lit(100)) / 100).alias("f"))
    pos = common.rank_by_fraction(frac, "f", ["id"], rows_per_cell).collect()
    assert sorted(r["_pos"] for r in pos) == list(range(100)) and all(r["_pos"] == round(r["f"] * 100) for r in pos)


def test_shards_hold_the_mixture(spark):
    rows = [(i, f"t{i}é" if i % 5 else None, "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    out = sharding.shard(plain(spark, rows), 16).collect()
    texts = {k: t for k, t, _ in rows}
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    total = Counter(s for _, _, s in rows)
    for source, n in total.items():
        mine = Counter(r["shard"] for r in out if r["source"] == source)
        assert all(abs(mine[s] - n / 16) <= 2 for s in range(16))
    for r in out:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "rows")
    again = sharding.shard(plain(spark, rows, parts=7), 16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_awkward_tables(spark):
    df = awkward(spark)
    out = sharding.shard(df, 16)
    assert out.count() == df.count() and len(out.columns) == len({c.lower() for c in out.columns})
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(i, 0) for i in range(16)]
    few = sharding.shard(df.limit(3), 16).collect()
    assert len({r["shard"] for r in few}) == 3 and sharding.shard(df.limit(0), 16).count() == 0


def test_pfair_schedule_meets_every_deadline():
    for weights in ({"a": 1.0}, {"a": 5, "b": 3, "c": 1, None: 0.01}, {f"s{i}": i + 0.5 for i in range(30)}):
        slots = mixing.rounded_weights(weights, 1024)
        assert sum(slots.values()) == 1024 and min(slots.values()) >= 1
        plan = mixing.pfair_period(slots)
        assert sorted(t for _, _, t, _, _ in plan) == list(range(1024))
        given = Counter()
        for s, i, t, release, due in plan:
            assert release <= t < due and given[s] == i
            given[s] += 1
            for k, n in slots.items():  # never a block or more from its target
                assert abs(Fraction((t + 1) * n, 1024) - given[k]) < 1


def test_mix_gives_every_row_and_holds_the_targets(spark):
    rows = [(i, f"t{i}", "hot" if i % 2 else f"s{i % 6}") for i in range(3000)]
    out = mixing.mix(plain(spark, rows), block_rows=4).collect()
    first = Counter(r["doc_id"] for r in out if r["epoch"] == 0)
    assert first == Counter(i for i, _, _ in rows)
    counts = Counter(s for _, _, s in rows)
    slots = mixing.rounded_weights({s: n**0.7 for s, n in counts.items()}, 1024)
    source_of = {r["slot"]: r["source"] for r in out}
    end = max(source_of) + 1
    given = Counter()
    for t in range(end):
        assert t in source_of
        given[source_of[t]] += 1
        assert all(abs(Fraction((t + 1) * n, 1024) - given[s]) < 1 for s, n in slots.items())
    for s, n in counts.items():
        epochs = Counter(r["epoch"] for r in out if r["source"] == s)
        assert all(epochs[e] == n for e in range(max(epochs)))  # all but the last are whole
    assert all(r["release"] <= r["slot"] < r["deadline"] and 0 <= r["offset"] < 4 for r in out)
    assert len({(r["slot"], r["offset"]) for r in out}) == len(out)
    some = mixing.mix(plain(spark, rows), weights={s: 1.0 for s in counts}, block_rows=4)
    assert some.where("epoch = 0").count() == len(rows)
    with pytest.raises(ValueError):
        mixing.mix(plain(spark, rows), weights={"hot": 1.0})


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 3e6**0.7, "b": 2e6**0.7, "c": 1.5e6**0.7, "d": 1e6**0.7, "e": 1e3**0.7}])
def test_schedule_keeps_to_the_unrounded_weights(weights):
    whole = mixing.whole_weights(weights)
    total = sum(map(Fraction, weights.values()))
    assert all(Fraction(whole[s], sum(whole.values())) == Fraction(w) / total for s, w in weights.items())
    given, n = Counter(), 0
    for s, i, t, release, due in mixing.pfair_stream([(s, w, 30_000 if s == "a" else 1) for s, w in whole.items()]):
        assert t == n and given[s] == i and release <= t < due
        given[s] += 1
        n += 1
        assert all(abs(n * w - given[k] * sum(whole.values())) < sum(whole.values()) for k, w in whole.items())
    assert n > 50_000 and given["a"] == 30_000


def test_mix_keeps_to_the_unrounded_weights(spark):
    rows = [(i, f"t{i}", "a" if i < 3000 else "b") for i in range(9000)]
    out = mixing.mix(plain(spark, rows), weights={"a": 1, "b": 2}, block_rows=1).where("offset = 0").select("source", "slot").collect()
    seen = Counter()
    for t, s in enumerate(r["source"] for r in sorted(out, key=lambda r: r["slot"])):
        seen[s] += 1
        assert abs(Fraction(t + 1, 3) - seen["a"]) < 1


def test_mix_of_awkward_tables(spark):
    df = awkward(spark)
    out = mixing.mix(df, block_rows=1)
    assert out.where("epoch = 0").count() == df.count()
    assert out.where("source is null and epoch = 0").count() == 2
    assert len(out.columns) == len(set(out.columns)) and mixing.mix(df.limit(0)).count() == 0


# ---- pipeline ----


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P

    vile = " vile scum"
    rows = [(i, prose(i, 60 + i % 40) + (vile if i % 9 == 0 else ""), "a" if i % 3 else "b") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "c") for i in range(1, 60, 7)]  # exact copies
    item = prose(999, 30)
    rows += [(2000, prose(5000, 20) + " " + item, "a"), (2001, None, None), (2002, "", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(0, 300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    left, texts = docs, {k: t for k, t, _ in rows}
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, left, str(tmp_path))
        if name != "sharding":
            assert set(out.columns) == set(docs.columns)
        out.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r["doc_id"] for r in left.select("doc_id").collect()])
    toxic, single, clean, mixed, sharded = seen
    assert not any(vile in (texts[k] or "") for k in toxic) and len(toxic) > 260
    kept_texts = [texts[k] or "" for k in single]
    assert len(set(kept_texts)) == len(kept_texts) and not {1001, 1008, 1015} & set(single) and {1, 8, 15} <= set(single)
    assert 2000 in single and set(clean) == set(single) - {2000}
    assert set(mixed) == set(clean) and len(mixed) >= len(clean)
    assert Counter(sharded) == Counter(mixed)
    whole = [r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()]
    assert Counter(whole) == Counter(sharded)


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    none = spark.createDataFrame([], "item_id long, text string")
    for name, df in (("odd", awkward(spark)), ("empty", awkward(spark).limit(0))):
        d = f"{tmp_path}/{name}"
        df.write.parquet(f"{d}/documents.parquet")
        none.write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        out = P.run(spark, d)
        assert set(df.columns) - {"shard", "slot"} <= set(out.columns) and out.columns.count("shard") == 1
        rows = out.select("doc_id", "text").collect()
        if name == "empty":
            assert rows == []
            continue
        # one clean label rejects nothing; copies, blank texts and repeated rows keep one
        fps = [(k, brute_fingerprint(t)) for k, t, _ in awkward_rows()]
        want = brute_components(fps)
        assert {r["doc_id"] for r in rows} <= {k for (k, _), c in want.items() if k == c}


def test_registered_queries():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert {"op3_decontaminate", "op9_repeats"} <= set(E.oracle_sql())
