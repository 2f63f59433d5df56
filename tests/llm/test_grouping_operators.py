"""MinHash groups, the prefix trie of conversations and spelling variants, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, awkward_rows, plain, prose

from thermocline.llm import minhash, spelling, trie


# ---- MinHash ----


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i)) if sets[i] else k, k == (least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def edited(words, n, seed):
    r = np.random.default_rng(seed)
    out = list(words)
    for at in r.choice(len(out), n, replace=False).tolist():
        out[at] = f"new{seed}x{at}"
    return " ".join(out)


@pytest.mark.parametrize("settings", [{}, {"region": 2, "rounds": 0}, {"region": 2, "deeper": (), "rounds": 0}, {"region": 2, "blocks": 1, "rounds": 0}])
def test_near_duplicates_against_brute_force(spark, settings):
    rows = [(k, t) for k, t, _ in awkward_rows()]
    for base in range(3):
        words = prose(900 + base, 120).split(" ")
        rows += [(1000 * (base + 1) + n, edited(words, n % 13, n)) for n in range(25)]
    rows += [(5000 + i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate((5, 6, 7, 2, 3, 3))]
    rows.append((6000, prose(5, 40_000)))  # very long
    long = [f"{w}{i % 40}" for i, w in enumerate(prose(7, 2_000).split(" "))]  # sets that do not travel
    rows += [(7000 + n, edited(long, 60 * n, n)) for n in range(5)]
    got = minhash.near_duplicates(plain(spark, [(k, t, "s") for k, t in rows]), **settings).collect()
    assert Counter(map(tuple, got)) == brute_near(rows)


def test_near_duplicates_of_awkward_tables(spark):
    df = awkward(spark)
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_near([(k, t) for k, t, _ in awkward_rows()])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    odd = minhash.multipliers(2000, 1)
    for n, common in ((5, 4), (300, 200)):
        x = r.integers(0, 1 << 64, 2 * n - common, np.uint64)
        a, b = minhash.minima(x[:n], odd), minhash.minima(x[n - common :], odd)
        assert abs((a == b).mean() - common / (2 * n - common)) < 0.06
    assert all((1 - 0.8**d) ** t < 1e-6 for d, t in ((minhash.DEPTH, minhash.HASHES // minhash.DEPTH), *minhash.DEEPER))


# ---- prefix trie ----


def brute_trie(seqs):
    """seqs: conv_id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in seqs.items():
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in members}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha[p]) for p, m in members.items())


def in_order(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def shared_heads(convs):
    out = {}
    for c, path in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + path[h:]
    return out


def talks():
    rows = []
    r = np.random.default_rng(8)
    for c in range(0, 300):
        if c % 60 == 40:
            continue  # some heads are absent
        for t in range(int(r.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {int(r.integers(0, 2 + t))} now"))
    rows += [(5000 + i, t, "user", "the same") for i in range(120) for t in range(3)]  # a hot sequence
    rows += [(7000 + i, t, "user", f"long {t}") for i in range(3) for t in range(70 + i)]  # over several blocks of columns
    rows += [(8000, None, None, None), (8000, 2, "a", None), (8001, None, "", ""), (8002, 1, "a", " \t"), (None, 1, "user", "nobody"), (8003, 5, "ab", "c"), (8004, 5, "a", "bc")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"least_turns": 40}, {"least_turns": 10, "last_rows": 16}, {"shard_turns": 30, "last_rows": 9}])
def test_trie_against_brute_force(spark, settings):
    rows = talks()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int, pos long").repartition(3)
    seqs = trie.sequences(df)
    got = trie.prefix_trie(seqs, **settings).collect()
    assert Counter(map(tuple, got)) == brute_trie(in_order(rows))
    got = trie.prefix_trie(trie.with_shared_heads(seqs), **settings).collect()
    want = brute_trie(shared_heads(in_order(rows)))
    assert Counter(map(tuple, got)) == want and sum(want.values()) > 300


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([], schema))).count() == 0
    repeated = [(3, 1, "u", "x y"), (3, 1, "u", "x y"), (4, 1, "u", "x y")]
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(repeated, schema)))
    assert Counter(map(tuple, got.collect())) == brute_trie({3: [("u", "x y")] * 2, 4: [("u", "x y")]})
    # 3 is rebuilt from the absent conversation 0, and has no turns if its own are no more than its head
    alone = trie.prefix_trie(trie.with_shared_heads(trie.sequences(spark.createDataFrame([(c, 1, "u", "x") for c in range(1, 20)], schema))))
    want = brute_trie(shared_heads({c: [("u", "x")] for c in range(1, 20)}))
    assert Counter(map(tuple, alone.collect())) == want


# ---- spelling variants ----


def brute_words(rows, least_count=5):
    n = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        if others:
            best = min(others, key=lambda b: (-words[b], b))
            if words[best] >= 5 * words[a]:
                form[a] = best

    def root(a):
        return root(form[a]) if a in form else a

    return Counter((a, form.get(a), root(a), n, len(near[a]), words[form[a]] if a in form else None) for a, n in words.items())


def vocabulary():
    r = np.random.default_rng(6)
    words = Counter()
    for stem in ["letter", "station", "übergang", "àéîõüÿ", "abcdefghij", "aaaaaaa"]:
        n = int(r.integers(3000, 9000))
        words[stem] += n
        for _ in range(40):
            w, k = stem, n
            for _ in range(int(r.integers(1, 4))):
                at, c = int(r.integers(0, len(w) + 1)), "aeßzàÿ"[int(r.integers(0, 6))]
                w = (w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :])[int(r.integers(0, 3))]
                k = max(5, k // int(r.integers(2, 9)))
                if len(w) >= 6:
                    words[w] = max(words[w], k)
    return dict(words)


@pytest.mark.parametrize("hot_chunk", [1_000, 2])
def test_variants_against_brute_force(spark, hot_chunk):
    words = vocabulary()
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), hot_chunk=hot_chunk).collect()
    want = brute_variants(words)
    assert Counter(map(tuple, got)) == want
    assert sum(f is not None and f != root for _, f, root, *_ in want) > 5  # chains


def test_spelling_variants_of_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 50)
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 20)
    rows = [(k, t) for k, t, _ in awkward_rows()]
    rows += [(i, f"Station stations,STATION sTationes {prose(i % 4, 30)} Übergang übergang") for i in range(400)]
    rows.append((7, "station " * 30_000 + "y" * 200_000))  # very long, and a very long run
    got = spelling.spelling_variants(plain(spark, [(k, t, "s") for k, t in rows])).collect()
    assert Counter(map(tuple, got)) == brute_variants(brute_words(rows))
    assert any(r["form"] for r in got)
    df = awkward(spark)
    assert spelling.spelling_variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(df.limit(0)).count() == 0
