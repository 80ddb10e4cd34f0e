"""Corpus operators against brute force, on a fixture with nulls, empties, copies, ties and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, language, lines, mixing, packing, simhash, substrings, token_output, topk, toxicity
from millrace.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, length long, row long, key string, line string"
CLASH = (7, 7, 7, "k", "l")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = words(rng, 70)
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", " \n\t ", "äé 漢字 ﬁ  x", "a", "!!! 12", None]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(4)]
    texts += ["\n".join(words(rng, 12) for _ in range(5)) for _ in range(4)]
    base = texts[-1].split("\n")
    texts += ["\n".join([base[0], base[1][:-1] + "z", "", words(rng, 9)]), words(rng, 6000)]
    out = [(i, t, "en", [None, "a", "b", "ü", "c"][i % 5], len(t or ""), *CLASH) for i, t in enumerate(texts)]
    return out + [out[2], out[2], (None, texts[3], None, None, None, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*pairs, pairs[0], (5, 5), (None, 3)], "a long, b long")).collect()}
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in list(got)[::7] for b in list(got)[::5])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_is_gapless_whole_and_tight(docs, empty, rows):
    got = packing.pack_documents(docs, capacity=64).collect()
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text_of = {d: t for d, t, *_ in rows}
    for r in got:
        if r.doc_id is not None:
            ids = np.array([*tok.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.start == (0 if r.piece == 0 else (len(ids) % 64 or 64) + 64 * (r.piece - 1))
    total = sum(r.length for r in got)
    assert len(by_seq) <= 1.05 * total / 64 + 1
    assert sorted(by_doc[43]) == [(0, 0, 1)] and len(by_doc[2]) == 3 * len({p for p, _, _ in by_doc[2]})
    assert packing.pack_documents(empty).count() == 0


def test_plans_match_item_by_item_packing():
    rng = random.Random(5)
    for _ in range(20):
        cap = rng.choice([10, 64, 100])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 300))]
        hist = collections.Counter(items)
        room = []
        for x in sorted(items, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= x
            else:
                room.append(cap - x)
        assert sum(b.count for b in packing.plan_best_fit_decreasing(hist, cap)) == len(room)
        for plan in (packing.plan_best_fit_decreasing, packing.plan_large_pairs):
            back = collections.Counter()
            for b in plan(hist, cap):
                assert b.count > 0 and b.room == cap - sum(n * k for n, k in b.runs) >= 0
                for n, k in b.runs:
                    back[n] += k * b.count
                assert plan is not packing.plan_large_pairs or sum(k for n, k in b.runs if 3 * n > cap) <= 2
            assert back == hist


def test_id_matrix_round_trip(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in token_output.packed_matrix(docs, capacity=128).collect():
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 128 and not ids[r.n_tokens :].any() and r.position_resets == r.cu_seqlens[:-1]
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            got[doc].append((piece, tuple(ids[a:b].tolist())))
    for doc, text, *_ in rows:
        if doc == 2 or doc is None:
            continue
        assert sum((list(p) for _, p in sorted(got[doc])), []) == tok.encode(text or "", add_special_tokens=False).ids + [0]
    repeated = tok.encode(rows[2][1], add_special_tokens=False).ids + [0]
    n = collections.Counter(p for p, _ in got[2])
    assert set(n.values()) == {3} and sum(len(p) for _, p in got[2]) == 3 * len(repeated)
    assert sum((list(p) for _, p in sorted(got[None])), []) == tok.encode(rows[3][1], add_special_tokens=False).ids + [0]
    assert token_output.packed_matrix(empty).count() == 0


def test_ids_of_the_corpus_equal_the_tokenizer(sf_dir, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.tokens import encoder

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert np.frombuffer(encoder("byte_bpe_50k").ids(r.text), "<u4").tolist() == tok.encode(r.text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" a", "a\n", "\ta b\x1f c", "a \u00a0b", "",  "a  b", " lead", "trail ", "x \n y", "it's <|endoftext|> ok", "é  b", "don't 's"])
def test_ids_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.tokens import encoder

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(encoder("byte_bpe_50k").ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_simhash_groups_match_brute_force(docs, empty, rows):
    fps = [(d, simhash.fingerprint(t)) for d, t, *_ in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)].append(d)
    want = sorted((d if d is not None else -1, f"{f:016x}", min(least[find(i)])) for i, (d, f) in enumerate(fps))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == want
    assert simhash.simhash_groups(empty).count() == 0


def test_near_copies_match_brute_force(spark, docs, empty, rows):
    """Pairs are either clear of 0.8 or well above it, so the bands' chance of a miss is negligible."""
    rng = random.Random(9)
    base = [words(rng, n).split() for n in (60, 200, 900)]
    extra = []
    for b in base:
        for edits in (1, len(b) // 60, len(b) // 4):
            x = list(b)
            for at in rng.sample(range(len(b)), edits):
                x[at] = "edit" + str(rng.randrange(10**6))
            extra.append(" ".join(x))
        extra += [" ".join(b), "  ".join(b).upper()]
    more = [(1000 + i, t, "en", "a", len(t), *CLASH) for i, t in enumerate(extra)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    given = sorted({(d, t) for d, t, *_ in rows + more if d is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = [simhash.shingle_set(t or "") for _, t in given]
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(given):
        groups[find(i)].append(d)
    got = simhash.first_of_groups(both)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(d for d in ids if d is not None) == sorted(min(g) for g in groups.values())
    assert ids.count(None) == 1 and simhash.first_of_groups(empty).count() == 0


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(9)
    seed = rng.getrandbits(64)
    fps = {seed}
    for _ in range(300):
        x = seed
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, hot_bucket=8)).collect()}
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            x, y = simhash.signed(a), simhash.signed(b)
            assert (roots.get(x, x) == roots.get(y, y)) == (find(a) == find(b))


def test_mixing_meets_targets(docs, empty, rows):
    got = mixing.entropy_mix(docs).collect()
    sizes = [len((t or "").encode().split()) for _, t, *_ in rows]
    assert sorted(r.size for r in got) == sorted(sizes)
    per = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        per[r.source][0] += r.size
        per[r.source][1] = r.target
        per[r.source][2] += r.taken
    assert sum(p[1] for p in per.values()) == pytest.approx(sum(sizes))
    order = sorted(per, key=lambda s: (s is None, s))
    free = [(per[s][1] / (1 + i % 3)) for i, s in enumerate(order) if per[s][1] < 3 * per[s][0] - 1e-6]
    assert max(free) - min(free) < 1e-6
    largest = collections.defaultdict(int)
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
    for source, (size, target, taken) in per.items():  # a text is taken whole or not
        assert abs(taken - target) <= max(20, largest[source] / 2)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.entropy_mix(docs.repartition(7)).collect()))
    assert mixing.entropy_mix(empty).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)


def test_base_rates_with_a_binding_cap_match_a_solver(spark):
    """The multiplier of each source solves sum(words * min(cap, base * exp(lambda))) = target; found here by bisection."""
    rng = random.Random(6)
    data = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", None]), rng.choice([0.0, 0.02, 0.5, 1.0, 50.0, None])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, b double")
    got = mixing.entropy_mix(df, base=F.col("b")).collect()
    base = {r[0]: 1.0 if r[3] is None else r[3] for r in data}
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            met = sum(r.size * min(3, base[r.doc_id] * np.exp(mid)) for r in own)
            low, high = (mid, high) if met < own[0].target else (low, mid)
        assert abs(low) > 1e-6 and any(base[r.doc_id] * np.exp(low) > 3 for r in own)
        for r in own:
            assert r.rate == pytest.approx(min(3, base[r.doc_id] * np.exp(low)), rel=1e-5)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60


def test_targets_of_many_sources(spark):
    rng = random.Random(22)
    sizes = {(None if i == 7 else f"s{i:04d}"): rng.choice([0, 1, 5, 50, 3000]) for i in range(1500)}
    got = {r.source: r for r in mixing.capped_targets(mixing.cyclic_weights(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(8)), 3).collect()}
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: 1 + i % 3 for i, x in enumerate(order)}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if level * weight[x] > 3 * sizes[x]}
        if not full:
            break
        target |= {x: 3.0 * sizes[x] for x in full}
        open_, left = open_ - full, left - sum(3.0 * sizes[x] for x in full)
    target |= {x: level * weight[x] for x in open_}
    assert set(got) == set(sizes)
    for x, r in got.items():
        assert r.weight == weight[x] and r.target == pytest.approx(target[x], rel=1e-9)


def test_odd_base_rates(spark):
    nan = float("nan")
    data = [(i, "w " * 10, "a" if i % 2 else "b", [1.8e-35, nan, 1.8e-35, None, 1e30][i % 5]) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, b double")
    got = mixing.entropy_mix(df, base=F.col("b")).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    tiny = df.where("b = 1.8e-35")
    own = mixing.entropy_mix(tiny, base=F.col("b")).collect()
    assert all(r.rate == pytest.approx(r.target / r.source_size, rel=1e-6) for r in own)


def test_line_dedup_matches_brute_force(docs, empty, rows):
    seen, links, want = [], {}, {}

    def find(x):
        while links[x] != x:
            x = links[x]
        return x

    ordered = sorted({(d, t) for d, t, *_ in rows if t}, key=lambda r: (r[0] is not None, r[0]))
    all_lines = [(d, t, i, x) for d, t in ordered for i, x in enumerate(t.split("\n")) if x and not x.isspace()]
    for _, _, _, x in all_lines:
        if x not in links:
            links[x] = x
            for y in seen:
                a, b = lines.shingles(x), lines.shingles(y)
                if min(len(x), len(y)) >= lines.SHINGLE and len(a & b) >= 0.8 * len(a | b):
                    links[find(x)] = find(y)
            seen.append(x)
    done = set()
    for d, t, i, x in all_lines:
        if find(x) in done:
            want.setdefault((d, t), set()).add(i)
        done.add(find(x))
    got = lines.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == [c for c in docs.columns]
    for r in got.collect():
        originals = [t for d, t, *_ in rows if d == r.doc_id]
        cleaned = {None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get((r.doc_id, t), ())) for t in originals}
        assert r.text in cleaned and r.n_chars == len(r.text or "")
    assert got.count() == len(rows) and lines.dedup_lines(empty).count() == 0


def test_line_dedup_of_one_component_of_half_the_lines(spark):
    rng = np.random.default_rng(8)
    text = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 200))
    base = text()
    copies = [base[:at] + chr(65 + i % 26) + base[at + 1 :] for i, at in enumerate(rng.integers(0, 200, 1500).tolist())]
    rows = [(i, x) for i, x in enumerate([*copies, *[text() for _ in range(1500)]])]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    assert {r.doc_id: r.text for r in found} == {i: "" if 0 < i < 1500 else x for i, x in rows}


def test_line_pairs_just_over_the_threshold_are_found(spark):
    rng = random.Random(14)
    pairs = []
    while len(pairs) < 2000:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(94, 126)))
        x, y = rng.randint(5, 40), rng.randint(50, 88)
        b = a[:x] + "#" + a[x + 1 : y] + "#" + a[y + 1 :]
        of_a, of_b = lines.shingles(a), lines.shingles(b)
        if 0.8 <= len(of_a & of_b) / len(of_a | of_b) <= 0.85:
            pairs.append((a, b))
    data = [(i, "\n".join(x for pair in pairs[i::40] for x in pair)) for i in range(40)]
    got = lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).agg(F.sum("n_removed")).first()[0]
    print(got)
    assert 1997 <= got <= 2000


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.choice("abcdefghijklmnop") for _ in range(200)]
    body = []
    for _ in range(120):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(200)] = rng.choice("xyz")
        body.append("".join(x))
    body = sorted(set(body))
    df = spark.createDataFrame([(i, 1, i, len(body)) for i in range(len(body))], "line long, band long, comp long, n long")
    monkeypatch.setattr(lines, "BLOCK_LINES", 40)
    found = connected_components(lines.block_links(df, spark.createDataFrame(list(enumerate(body)), "line long, body string"), 0.8))
    roots = {r.node: r.root for r in found.collect()}
    parent = list(range(len(body)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(body)):
        for j in range(i):
            a, b = lines.shingles(body[i]), lines.shingles(body[j])
            if len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    assert all((roots.get(i, i) == roots.get(j, j)) == (find(i) == find(j)) for i in range(len(body)) for j in range(i))


def test_fingerprints_of_edits(docs, empty, rows):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_edits(docs, parts=5).collect() if r.doc_id not in (None, 2)))
    # rows 2 repeat a text, so any of the copies comes next
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (d, t, *_) in enumerate(order):
        a, b = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(a) // 3
        if d not in (None, 2):
            want.append((d, len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()))
    assert got == sorted(want)
    prints = collections.defaultdict(set)
    for r in fingerprints.fingerprint_edits(docs).collect():
        prints[rows[r.doc_id][1] if r.doc_id is not None else rows[3][1]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_sketches_merge_and_estimate_containment_of_unequal_texts(spark):
    rng = random.Random(31)
    whole = words(rng, 3000).split()
    other = words(rng, 2000).split()
    rows = [(1, " ".join(whole), " ".join(whole[500:800])), (2, " ".join(whole), " ".join(whole[100:400] + other[:300])), (3, " ".join(other), " ".join(whole[:50])), (4, "", "")]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", "a", "b", a.alias("x"), b.alias("y"))
    both = fingerprints.merged(F.col("x"), F.col("y"))
    for r in df.select("i", "a", "b", fingerprints.containment(F.col("y"), F.col("x")).alias("c"), fingerprints.likeness(F.col("x"), F.col("y")).alias("j"), both.alias("m"), fingerprints.merged(F.col("y"), F.col("x")).alias("n"), "x", "y").collect():
        assert r.m == r.n and r.m.hashes == sorted(set(r.x.hashes) | set(r.y.hashes))
        if r.i == 4:
            assert r.c == r.j == 1
            continue
        p, q = sets(r.a), sets(r.b)
        assert r.c == pytest.approx(len(p & q) / len(q), abs=0.08)
        assert r.j == pytest.approx(len(p & q) / len(p | q), abs=0.04)


def test_merging_is_a_union(spark):
    rng = random.Random(8)
    texts = [words(rng, n) for n in (0, 1, 3, 4, 5, 9, 40, 400)]
    rows = [(x, y, z) for x in texts for y in texts[:4] + texts[-1:] for z in texts[::3]]
    x, y, z = (fingerprints.sketch(F.col(c)) for c in "xyz")
    df = spark.createDataFrame(rows, "x string, y string, z string").select(x.alias("x"), y.alias("y"), z.alias("z"))
    m = lambda a, b: fingerprints.merged(a, b)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    told = df.select(m(m(x, y), z).alias("l"), m(x, m(y, z)).alias("r"), m(x, x).alias("same"), m(m(x, y), m(x, y)).alias("twice"), m(x, y).alias("once"), m(y, x).alias("turned"), "x", fingerprints.likeness(x, m(x, x)).alias("own"), fingerprints.likeness(m(x, y), m(x, z)).alias("mixed"), fingerprints.from_text(fingerprints.as_text(x)).alias("back"))
    for r in told.collect():
        assert r.l == r.r and r.same == r.x == r.back and r.twice == r.once == r.turned and r.own == 1.0 and 0 <= r.mixed <= 1


def test_sketches_are_smaller_than_texts_and_err_as_stated(spark):
    rng = random.Random(9)
    for n, trials in ((100, 60), (1000, 30)):
        pairs = []
        for _ in range(trials):
            a = words(rng, n).split()
            b = a[: n // 2] + words(rng, n - n // 2).split()
            pairs.append((" ".join(a), " ".join(b)))
        sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(n - 4)}  # noqa: B023, E731
        df = spark.createDataFrame(pairs, "a string, b string")
        a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
        got = df.select("a", "b", fingerprints.likeness(a, b).alias("j"), F.length(fingerprints.as_text(a)).alias("n")).collect()
        gaps = []
        for r in got:
            p, q = sets(r.a), sets(r.b)
            gaps.append((r.j - len(p & q) / len(p | q)) ** 2)
        assert sum(r.n for r in got) < 0.45 * sum(len(r.a) for r in got)
        j, size = 1 / 3, 1.5 * n
        assert np.sqrt(np.mean(gaps)) < 1.5 * np.sqrt(3 * j * (1 - j) / size)


def test_a_language_of_equal_rows_is_learned(spark):
    rng = random.Random(12)
    xa = [(i, " ".join(rng.choice(["kala", "moro", "tinu"]) for _ in range(20)), "xa") for i in range(200)]
    for trial in range(4):
        yb = spark.range(20000).select(F.lit(1000 + trial).cast("long").alias("doc_id"), F.lit(f"grzy wchod szcz prze {trial}").alias("text"), F.lit("yb").alias("lang"))
        train = spark.createDataFrame(xa, "doc_id long, text string, lang string").union(yb)
        found = {r.lang: r["count"] for r in language.sampled(train, 50).groupBy("lang").count().collect()}
        assert found == {"xa": 50, "yb": 1}
    assert language.identify_language(train.where("doc_id in (0, 1003)").dropDuplicates(), F.lit(True)).where("lang_pred = 'yb'").count() == 1


def test_predictions_are_the_nearest_centroids_by_brute_force(spark):
    rng = random.Random(13)
    tongues = {f"l{i}": [words(rng, 1) for _ in range(5)] for i in range(3)}
    data = [(i, " ".join(rng.choice(tongues[f"l{i % 3}"]) for _ in range(rng.randint(1, 25))), f"l{i % 3}") for i in range(150)]
    data += [(1000 + i, words(rng, 12), None) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    (model,) = language.fit(df, F.lit(True), 40, 3)
    assert len(model.vectors) > len(model.langs)
    for r in language.identify_language(df, F.lit(True), sample=40, clusters=3).collect():
        counts = language.gram_counts(data[r.doc_id][1] if r.doc_id < 1000 else data[r.doc_id - 850][1])
        v = np.sqrt(counts) * model.idf
        v = v / np.linalg.norm(v)
        best = {}
        for of, c in zip(model.of, model.vectors):
            best[model.langs[of]] = max(best.get(model.langs[of], -1), float(v @ c))
        top = max(best.values())
        assert best[r.lang_pred] == pytest.approx(top, abs=1e-5) and r.distance == pytest.approx(1 - top, abs=1e-5)
        assert r.rejected == (1 - top > model.radius[model.langs.index(r.lang_pred)]) or abs(1 - top - model.radius[model.langs.index(r.lang_pred)]) < 1e-5
        weight = sum(np.exp(language.SHARP * x) for x in best.values())
        assert r.score == pytest.approx(np.exp(language.SHARP * top) / weight, rel=1e-3)
    assert any(r.rejected for r in language.identify_language(df, F.lit(True), sample=40, clusters=3).where("doc_id >= 1000").collect())


def test_language_of_clear_texts(spark, empty):
    rng = random.Random(4)
    tongues = {"xa": ["kala", "moro", "tinu", "sabe"], "yb": ["grzy", "wchod", "szcz", "prze"]}
    data = [(i, " ".join(rng.choice(tongues[k]) for _ in range(40)), k) for i, k in enumerate(["xa", "yb"] * 60)] + [(900, None, "xa"), (901, "12 !?", None), (902, "\u00b2 \u00bd \u2460", None), (None, "kala moro", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_language(df, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(False))).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in data[:120])
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[None].lang_pred == "xa"
    assert got[900].score == 0 and got[900].rejected
    assert language.identify_language(empty, F.lit(True)).count() == 0


def test_every_language_is_learned_and_samples_are_bounded(spark, monkeypatch):
    rng = random.Random(14)
    tongues = {f"l{i}": [words(rng, 1) for _ in range(6)] for i in range(7)}
    data = [(i, " ".join(rng.choice(tongues[f"l{i % 7}"]) for _ in range(30)), f"l{i % 7}", "x", 1) for i in range(140)]
    data += [data[0]] * 300
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string, weight int")
    assert language.sampled(df.select("doc_id", "text", "lang"), 5).count() == 35
    one = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.identify_language(df, F.lit(True)).collect()}
    monkeypatch.setattr(language, "LANGS", 3)
    several = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.identify_language(df, F.lit(True)).collect()}
    assert one == several and all(one[i][0] == k for i, _, k, *_ in data[:140])


def test_toxicity_index_is_exact(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        vectors.append((at, w / np.sqrt(w @ w)))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    for share in (1 / 16, 0.2, 2):
        monkeypatch.setattr(toxicity, "DENSE", share)
        index = toxicity.BlockMaxIndex(vectors, list(range(500)), 40)
        dense = np.zeros((500, 40))
        for i, (at, w) in enumerate(vectors):
            dense[i, at] = w
        added, bounds = index.frequent(vectors)
        for i in range(0, 500, 17):
            cos = np.round(dense @ dense[i], 12)
            want = sorted((-c, j) for j, c in enumerate(cos) if c > 0)[:15]
            places, got = index.nearest(*vectors[i], 15, (added[i], bounds[i]))
            assert index.ids[places].tolist() == [j for _, j in want]
            assert got == pytest.approx([-c for c, _ in want])
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(out) == docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in out)
    assert toxicity.score_toxicity(empty, labels, F.lit(True)).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0), F.lit(True)).count() == docs.count()
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.1}


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_toxic_terms_count_at_any_share_of_toxic_labels(spark, share):
    """One word tells: 90 % of the toxic and 10 % of the clean documents hold it."""
    rng = random.Random(17)
    data = []
    for i in range(600):
        toxic = int(rng.random() < share)
        telling = rng.random() < (0.9 if toxic else 0.1)
        data.append((i, " ".join([rng.choice(["plain", "other", "thing"]) for _ in range(8)] + ["vile"] * telling), toxic, int(telling)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int, telling int")
    assert "vile" in {r.term for r in toxicity.telling_terms(df).collect()}
    out = toxicity.score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") < 500).join(df, "doc_id")
    assert out.where("predicted = telling").count() == 600


def test_all_words_take_part_in_the_cosine(spark):
    """The vocabulary is every word of the examples, and vectors hold words that tell nothing."""
    data = [(i, f"plain word{i} thing" + (" vile" if i % 2 else ""), i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert {"plain", "thing", "vile", *(f"word{i}" for i in range(60))} <= set(model.terms.ids)
    at, w = model.terms.vector("plain word3")
    assert len(at) == 2 and (w > 0).all() and w @ w == pytest.approx(1)
    # a word of no example is part of the length
    also, v = model.terms.vector("plain word3 unheard")
    assert (also == at).all() and v @ v < 0.999 and v / v[0] == pytest.approx(w / w[0])
    assert model.score(["vile plain"])[0][0] > 0.5 > model.score(["plain word2"])[0][0]


def test_scores_match_brute_force(spark):
    """Norms, neighbours, votes, calibration and scores of the whole operator, from the fitted weights on in plain Python."""
    rng = random.Random(21)
    pool = [words(rng, 1) for _ in range(60)]
    data = []
    for i in range(260):
        toxic = i % 4 == 0
        body = [rng.choice(pool) for _ in range(rng.randint(1, 40))] + ["vile"] * (toxic and rng.random() < 0.8) + ["rotten"] * (toxic and rng.random() < 0.5)
        rng.shuffle(body)
        data.append((i, " ".join(body), int(toxic)))
    data += [(300, "vile plain", None), (301, "vile plain " + " ".join(f"unheard{i}x" for i in range(5000)), None), (302, None, None), (303, "unheardof", None), (304, data[0][1], None), (304, data[1][1], None)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    docs, labels, learn = df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") < 200
    model = toxicity.fit(docs, labels, learn, k=7)
    terms, n_examples = model.terms, 200
    assert terms.unheard == pytest.approx(toxicity.PLAIN_WEIGHT * (np.log(n_examples + 1) + 1))

    def vector(text):
        tf = collections.Counter()
        others = 0.0
        for w, n in collections.Counter(toxicity.words(text)).items():
            for x in (w, *toxicity.stems(w)):
                if x in terms.ids:
                    tf[x] += n
            others += 0 if w in terms.ids else ((1 + np.log(n)) * terms.unheard) ** 2
        v = {x: (1 + np.log(n)) * terms.weight[terms.ids[x]] for x, n in tf.items()}
        norm = np.sqrt(sum(x * x for x in v.values()) + others)
        return {x: y / norm for x, y in v.items()} if v else {}

    examples = [(i, vector(t), y) for i, t, y in data if i < 200]
    n_toxic = sum(y for *_, y in examples)
    prior = (n_toxic + 0.1) / (n_examples + 1)

    def vote(v, without=None):
        near = sorted((-round(sum(v[x] * e[x] for x in v.keys() & e.keys()), 12), i, y) for i, e, y in examples if i != without)
        near = [x for x in near if x[0] < 0][:7]
        pull = [1 / (1.05 + c) for c, *_ in near]
        return (sum(p * y for p, (*_, y) in zip(pull, near)) + prior) / (sum(pull) + 1), [i for _, i, _ in near]

    # isotonic values by the max-min formula over the examples' own votes; every example stands for one row
    own = sorted((round(vote(e, i)[0], 9), y) for i, e, y in examples)
    levels = sorted({v for v, _ in own})
    totals = [(sum(y for v, y in own if v == x), sum(1 for v, _ in own if v == x)) for x in levels]
    mean = lambda a, b: sum(t for t, _ in totals[a : b + 1]) / sum(n for _, n in totals[a : b + 1])
    fitted = [max(min(mean(j, k) for k in range(i, len(levels))) for j in range(i + 1)) for i in range(len(levels))]
    pools = collections.defaultdict(lambda: [0, 0])
    for f, (t, n) in zip(fitted, totals):
        pools[round(f, 9)][0] += t
        pools[round(f, 9)][1] += n
    value = {x: (pools[round(f, 9)][0] + prior) / (pools[round(f, 9)][1] + 1) for x, f in zip(levels, fitted)}
    scored = {}
    for r in toxicity.score_toxicity(docs, labels, learn, k=7).collect():
        scored.setdefault(r.doc_id, []).append(r)
    for i, text, _ in data:
        v = vector(text)
        if i == 304:
            assert len(scored[i]) == 2
            continue
        (r,) = scored[i]
        if not v:
            assert r.neighbours == [] and r.score == model.blank
            continue
        share, near = vote(v)
        below = [x for x in levels if x <= share]
        assert r.score == pytest.approx(value[below[-1]] if below else value[levels[0]], abs=1e-9) and sorted(r.neighbours) == sorted(near)
        assert r.predicted == (r.score >= 0.5)
    assert len(vector(data[261][1])) == len(vector(data[260][1])) and max(vector(data[261][1]).values()) < 0.5 * max(vector(data[260][1]).values())


def test_toxicity_on_held_out_labels(spark, sf_dir):
    d = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    r = toxicity.score_toxicity(docs, labels, ~held).join(labels, "doc_id").where(held)
    assert r.where("predicted = toxic").count() >= 0.9 * r.count()  # from some 320 labels


def test_top_k_matches_brute_force(spark):
    rng = random.Random(8)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    data[7] = (7, data[3][1])
    data += [(401, None), (402, [1.0, None] + [0.0] * 4), (403, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (50, data[50][1])]
    twice = max((i for i in range(1, 400) if i % 50), key=lambda i: sum(a * b for a, b in zip(data[i][1], data[0][1])))
    data.append(data[twice])
    df = spark.createDataFrame([(*r, 1, 2, "f") for r in data], "vec_id long, embedding array<double>, part int, range int, floor string")
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in [*data[:400], data[50], data[twice]]]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") % 50 == 0, range_rows=90, query_rows=3).collect()}
    assert [got[0, r][0] for r in (1, 2)] == [twice, twice]
    for q, v in ok[:400:50]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 40 and topk.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_passages_are_found(docs, empty, rows):
    got = substrings.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    # the four texts that share a passage of 70 words, and whole copies
    assert {(51, 50), (52, 50), (53, 50)} <= pairs
    for r in got:
        a, b = rows[r.doc_id if r.doc_id is not None else 3][1].lower().split(), rows[r.other_doc_id if r.other_doc_id is not None else 3][1].lower().split()
        if r.similarity == 1:
            assert a[r.start : r.start + r.words] == b[r.other_start : r.other_start + r.other_words]
        assert r.words >= 50 and r.similarity >= 0.8
    assert substrings.repeated_passages(empty).count() == 0


def test_passages_of_split_origin_are_found(spark):
    """Documents 0-2 and 4-6 hold parts below 50 words of a passage that 3 and 7 hold whole."""
    for seed in range(3):
        rng = random.Random(100 + seed)
        p = words(rng, 80).split()
        pad = lambda x: " ".join([words(rng, 30), *x, words(rng, 30)])
        parts = [p[:45], p[18:63], p[35:80]]
        bodies = [*map(pad, parts), pad(p), *map(pad, parts), pad(p), pad(p)]
        df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
        got = {(r.doc_id, r.other_doc_id) for r in substrings.repeated_passages(df).collect() if r.words >= 80 and r.similarity == 1}
        assert (7, 3) in got and any(d == 8 for d, _ in got)


def test_changed_passages_of_split_origin_are_found(spark, monkeypatch):
    """Texts before and after the source hold parts below 50 words of a passage, so it is neither first nor last with any seed of the changed one."""
    rng = random.Random(44)
    pad = lambda x: " ".join([words(rng, 30), *x, words(rng, 30)])
    bodies, want = [], set()
    for _ in range(12):
        p = words(rng, 80).split()
        q = list(p)
        for at in rng.sample(range(1, 79), 10):
            q[at] = f"edit{rng.randrange(10**9)}"
        parts = [p[:35], p[22:58], p[45:80]]
        n = len(bodies)
        bodies += [*map(pad, parts), pad(p), *map(pad, parts), pad(q)]
        want.add((n + 7, n + 3))
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = [tuple(r) for r in substrings.repeated_passages(df).collect()]
    assert {(r[0], r[3]) for r in got} == want and all(r[2] >= 75 for r in got)
    monkeypatch.setattr(substrings, "PAIRED_PLACES", 2)
    assert sorted(map(tuple, substrings.repeated_passages(df).collect())) == sorted(got)


def test_side_bits_lose_no_pair():
    """Stretches of 50 words at 0.8 pass beside each of their unchanged seeds, whichever words were replaced, left out or put in; other texts don't."""
    rng = np.random.default_rng(9)
    sizes, slack, far = substrings.sides(50, 0.8)
    word = lambda n: rng.integers(0, 40, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tried = passed = 0
    for _ in range(300):
        a = word(50)
        kept = np.sort(rng.permutation(50)[: 50 - rng.integers(0, 11)])
        places, b = np.full(50, -1), []
        for i in range(50):
            if i in kept:
                places[i] = len(b)
                b.append(a[i])
            elif rng.random() < 0.6:
                b.append(np.uint64(rng.integers(1 << 40, 1 << 60)))
        lead = [word(30), word(20)]
        x, y = np.concatenate([lead[0], a, word(40)]), np.concatenate([lead[1], np.array(b), word(40)])
        for i in range(47):
            if (places[i : i + 4] >= 0).all() and places[i + 3] - places[i] == 3:
                near, wide = substrings.side_bits(x, np.array([30 + i]), sizes, far)[0], substrings.side_bits(y, np.array([20 + places[i]]), sizes, far)[1]
                tried += 1
                assert len(substrings.alike_beside(near, ~wide.T, slack)) == 1
                z = rng.integers(1 << 40, 1 << 60, 200).astype(np.uint64)
                passed += len(substrings.alike_beside(near, ~substrings.side_bits(z, np.array([100]), sizes, far)[1].T, slack))
    assert tried > 2000 and passed < 0.01 * tried


def test_places_before_are_the_same_in_ranges(spark, monkeypatch):
    rng = random.Random(12)
    places = sorted({(rng.choice([None, *range(40)]), rng.randrange(90), rng.randrange(9), rng.randrange(4)) for _ in range(900)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    want, before = [], {}
    for doc, row, at, seed in places:
        if seed in before:
            want.append((row, at, before[seed][0], before[seed][-1]))
        before.setdefault(seed, []).append((row, at))
    df = spark.createDataFrame([(*p, 300) for p in places], "doc_id long, row long, at int, seed long, n long")
    for hot in (10, 1000):
        monkeypatch.setattr(substrings, "HOT_PLACES", hot)
        got = [(r.row, r.at, (r.o.row, r.o.at), (r.p.row, r.p.at)) for r in substrings.places_before(df, [5, 11, 30]).collect()]
        assert sorted(got) == sorted(want)


def test_changed_passages_are_found(spark):
    """Passages of 50, 60 and 100 words with up to 1 word in 5 substituted, known to be 0.8 alike or more by construction."""
    rng = random.Random(21)
    bodies, want = [], {}
    for n in range(270):
        size, rate = (50, 60, 100)[n % 3], (0.1, 1 / 7, 0.2)[n // 3 % 3]
        p = words(rng, size).split()
        q = list(p)
        # the end words stay, so the passage keeps its length
        for at in rng.sample(range(1, size - 1), int(rate * size)):
            q[at] = f"edit{rng.randrange(10**9)}"
        bodies += [" ".join([words(rng, 30), *x, words(rng, 30)]) for x in (p, q)]
        want.setdefault(rate, []).append((2 * n + 1, 2 * n))
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    got = {(r.doc_id, r.other_doc_id) for r in substrings.repeated_passages(df).collect()}
    recall = {rate: sum(p in got for p in pairs) / len(pairs) for rate, pairs in want.items()}
    print(recall)
    assert min(recall.values()) >= 0.98, recall


def test_longest_alike_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pairs = np.stack([np.cumsum(rng.integers(1, 4, 30)), np.cumsum(rng.integers(1, 3, 30))], axis=1)
        length = lambda s, e: 1 + sum(max(pairs[n] - pairs[n - 1]) for n in range(s + 1, e + 1))
        most = max(e - s + 1 for s in range(30) for e in range(s, 30) if e - s + 1 >= 0.8 * length(s, e) - 1e-9)
        s, e = substrings.longest_alike(pairs, 0.8)
        assert e - s + 1 == most and most >= 0.8 * length(s, e) - 1e-9
        worth = lambda s, e: e - s + 1 - sum(max(pairs[n] - pairs[n - 1]) - 1 for n in range(s + 1, e + 1))
        assert worth(*substrings.densest(pairs)) == max(worth(s, e) for s in range(30) for e in range(s, 30))


def test_chains_rise_and_alignment_trims():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 60, 80), rng.integers(0, 60, 80)
    for c in substrings.chains(x, y):
        assert (c[1:, 0] > c[:-1, 0] + c[:-1, 2]).all() and (c[1:, 1] > c[:-1, 1] + c[:-1, 2]).all()
    h = lambda t: substrings.word_hashes(t)
    a, b = h("q w e one two three four five six seven r t"), h("z one two three X five six seven p o")
    pairs, alike = substrings.aligned(a, b, np.array([[3, 1, 0, 1]]))
    assert pairs.tolist() == [[3, 1], [4, 2], [5, 3], [7, 5], [8, 6], [9, 7]] and alike == 6 / 7


def test_minimizers_are_the_least_of_their_windows():
    rng = random.Random(8)
    for n in (0, 3, 4, 7, 9, 60, 400):
        w = substrings.word_hashes(words(rng, n) if n else "")
        h, k = substrings.run_hashes(w, substrings.K), substrings.WINDOW
        span = min(k, len(h))
        want = {i for lo in range(len(h) - span + 1) for i in range(lo, lo + span) if len(h) and h[i] == min(h[lo : lo + span])}
        assert set(substrings.seeds(w)[1].tolist()) == want
    assert len(set(substrings.word_hashes("A a b Ab aB \u00e9 \u00c9\x0b\x1c").tolist())) == 6


def test_every_unchanged_passage_is_covered(spark):
    """Brute force over small texts of shared parts: each word of a run of 20 that occurs earlier lies in a passage."""
    rng = random.Random(77)
    parts = [words(rng, rng.randint(8, 30)).split() for _ in range(14)] + [["on"] * 45, ["a", "b", "c"] * 18]
    bodies = [sum((rng.choice(parts) for _ in range(rng.randint(2, 7))), []) for _ in range(70)]
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bodies)], "doc_id long, text string")
    held, missed, seen = set(), 0, {}
    for r in substrings.repeated_passages(df, min_words=20).collect():
        held |= {(r.doc_id, i) for i in range(r.start, r.start + r.words)}
        if r.similarity == 1:
            assert bodies[r.doc_id][r.start : r.start + r.words] == bodies[r.other_doc_id][r.other_start : r.other_start + r.other_words]
    n = 0
    for d, b in enumerate(bodies):
        for x in range(len(b) - 19):
            run = tuple(b[x : x + 20])
            f = seen.setdefault(run, (d, x))
            if f[0] != d or x - f[1] >= 20:
                n += 1
                missed += not all((d, x + i) in held for i in range(20))
    assert n > 500 and missed == 0


def test_partial_copies_hide_no_passage(spark):
    """Documents 1 and 2 hold halves of a passage of 70 words that 3 and 4 hold whole."""
    rng = random.Random(5)
    p = words(rng, 70).split()
    pad = lambda x: " ".join([words(rng, 30), *x, words(rng, 30)])
    df = spark.createDataFrame(list(enumerate([pad([]), pad(p[:35]), pad(p[35:]), pad(p), pad(p)])), "doc_id long, text string")
    assert {(r.doc_id, r.other_doc_id, r.words) for r in substrings.repeated_passages(df).collect()} == {(4, 3, 70)}


def test_long_texts_align_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 32, 200_000, dtype=np.uint64)
    b = a.copy()
    b[::5000] = 7
    h = [dict(zip(*(v.tolist() for v in substrings.seeds(w)))) for w in (a, b)]
    both = np.array([(x, h[1][s]) for s, x in h[0].items() if s in h[1]])
    tracemalloc.start()
    (chain,) = substrings.chains(both[:, 0], both[:, 1])
    pairs, alike = substrings.aligned(a, b, chain, 50, 0.8)
    assert tracemalloc.get_traced_memory()[1] < 1 << 28 and len(pairs) > 199_900 and alike > 0.999
    tracemalloc.stop()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from millrace.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf_dir), "test")
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    assert "sequence_id" in docs.columns


def test_pipeline_on_hostile_rows(spark, rows, empty, tmp_path):
    """Nulls, empty and repeated rows and clashing columns pass all stages, and each stage's decisions are those of its operator."""
    import corpus_pipeline
    from millrace.llm.common import materialize

    more = [(500 + i, ("vile rotten " if i % 2 else "fair mild ") * 6 + f"word{i % 7}", "en", "a", None, *CLASH) for i in range(60)]
    docs = spark.createDataFrame([*rows, *more], SCHEMA)
    labels = spark.createDataFrame([(500 + i, None, i % 2) for i in range(60)] + [(None, 1, 1), (500, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    labels.withColumn("text", F.lit("clash")).write.parquet(str(tmp_path / "labels.parquet"))
    taken = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)), "hostile")
        taken[name] = docs
        if name != "best-fit packing":
            assert docs.columns == before.columns
    count = lambda df, *cols: collections.Counter(map(tuple, df.select(*cols).collect()))
    from millrace.llm.queries import fold

    scored = toxicity.score_toxicity(taken["documents"], spark.read.parquet(str(tmp_path / "labels.parquet")), ~fold(5, 0))
    assert count(taken["toxicity"], "doc_id") == count(scored.where("score < 0.5"), "doc_id")
    assert 20 <= taken["documents"].count() - taken["toxicity"].count() <= 30
    assert count(taken["line dedup"], "doc_id", "source", "key") == count(taken["toxicity"], "doc_id", "source", "key")
    first = count(taken["SimHash near-dedup"], "doc_id")
    assert set(first) <= set(count(taken["line dedup"], "doc_id")) and sum(first.values()) < taken["line dedup"].count()
    mix = mixing.entropy_mix(taken["SimHash near-dedup"]).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert {r.doc_id: r.n for r in mix.collect()} == {d: n for (d,), n in count(taken["source mixing"], "doc_id").items()}
    packed = taken["best-fit packing"]
    assert count(packed.where("piece = 0"), "doc_id") == count(taken["source mixing"], "doc_id")
    stage = empty
    for _, of in corpus_pipeline.STAGES:
        stage = of(spark, stage, str(tmp_path))
    assert stage.count() == 0


def test_large_buckets_are_held_against_sketches_first(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(150)) for _ in range(5)]
    body = sorted({x[: (at := rng.randrange(150))] + rng.choice("xyz") + x[at + 1 :] for x in base for _ in range(12)})
    sketch = np.concatenate([lines.band_keys(x, [(0, len(x))])[1] for x in body])
    a, b = np.triu_indices(len(body), 1)
    nibbles = (sketch[:, :, None] >> np.arange(0, 64, 4)) & 15
    assert (lines.matches_of(sketch[a], sketch[b]) == (nibbles[a] == nibbles[b]).sum((1, 2))).all()
    df = spark.createDataFrame([(i, 1, i, len(body)) for i in range(len(body))], "line long, band long, comp long, n long")
    bodies = spark.createDataFrame(list(enumerate(body)), "line long, body string")
    held = spark.createDataFrame([(i, *map(int, s)) for i, s in enumerate(sketch)], "line long, " + ", ".join(f"{c} long" for c in lines.SKETCH))
    links = [sorted(map(tuple, lines.block_links(df, bodies, 0.8, sketches=s).collect())) for s in (None, held)]
    assert links[0] == links[1] and len(links[0]) == len(body) - 5


def test_later_links_join_components_by_their_roots(spark):
    rng = random.Random(7)
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 15))
    as_links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    groups = lambda df: sorted(sorted(x.members) for x in df.groupBy("root").agg(F.collect_list("node").alias("members")).collect())
    assert groups(lines.joined_roots(connected_components(as_links(first)), as_links(more))) == groups(connected_components(as_links(first + more)))


def test_open_buckets_meet_each_text_once(spark, monkeypatch):
    """Joins with texts and sketches grow with the lines, not with their places in buckets; small buckets are paired in tasks."""
    rng = random.Random(31)
    n, text = 60, words(rng, 20)
    body = [text[:k] + "#" + text[k + 1 :] for k in range(0, n // 2)] + [words(rng, 20) for _ in range(n // 2)]
    sketch = np.concatenate([lines.band_keys(x, [(0, len(x))])[1] for x in body])
    held = spark.createDataFrame([(i, *map(int, s)) for i, s in enumerate(sketch)], "line long, " + ", ".join(f"{c} long" for c in lines.SKETCH))
    bodies = spark.createDataFrame(list(enumerate(body)), "line long, body string")
    deep = spark.createDataFrame([(b, i, i, n) for b in range(20) for i in range(n)], "band long, line long, comp long, n int")
    found = connected_components(lines.block_links(deep, bodies, 0.8, sketches=held))
    assert [sorted(r.node for r in found.collect())] == [list(range(n // 2))]
    plan = lines.block_links(deep, bodies, 0.8, sketches=held)._jdf.queryExecution().optimizedPlan().toString()
    below = [plan[m.start() :] for m in __import__("re").finditer(r"Join ", plan)]
    assert below and not any("Generate explode(at" in x for x in below[-1:])  # the sketches are joined before a line is dealt to its buckets
    few = spark.createDataFrame([(b, i, i % 7, 20) for b in range(3) for i in range(20)], "band long, line long, comp long, n int")
    pairs = {tuple(r) for r in lines.bucket_pairs(few, 0.8).collect()}
    assert pairs == {(i, j) for i in range(20) for j in range(i + 1, 20) if i % 7 != j % 7}


def test_members_of_shared_bands_are_those_of_windows(spark):
    rng = random.Random(32)
    texts = [words(rng, 12) for _ in range(40)]
    docs = spark.createDataFrame([(i, i, "\n".join(t[:k] + "#" + t[k + 1 :] for k in range(4))) for i, t in enumerate(texts)], "doc long, doc_key long, text string").repartition(3)
    signed = lines.signed_lines(docs).cache()
    got = lines.shared_bands(signed).collect()
    banded = spark.createDataFrame([(r.line, int.from_bytes(bytes(r.bands[6 * k : 6 * k + 6]), "little")) for r in signed.where("bands is not null").collect() for k in range(lines.BANDS)], "line long, band long")
    want = lines.members_of(banded).collect()
    keys = lambda rows: sorted((r.least, r.line, r.before is None, r.before or 0, r.n) for r in rows)
    assert got and keys(got) == keys(want)


def test_written_tables_that_are_discarded_leave_no_files(spark):
    from millrace.llm.common import discard, materialize

    table = materialize(spark.range(10), "gone")
    path = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    discard(table)
    assert not __import__("os").path.exists("/" + path.lstrip("/"))


def test_chains_are_deleted_once_passages_are_written(spark, empty):
    """The chains' other halves are written, so that the texts exchanged for them are gone before the next exchange of texts."""
    import pathlib

    from millrace.llm.common import shared_dir

    folder = pathlib.Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    held = lambda: {p.name for k in ("chains", "halves", "dense") for p in folder.glob(f"millrace-{k}-*")}
    before, passage = held(), words(random.Random(33), 60)
    docs = spark.createDataFrame([(i, f"{i} {passage}") for i in range(3)], "doc_id long, text string")
    found = substrings.repeated_passages(docs)
    assert held() == before and sorted(r.doc_id for r in found.collect()) == [1, 2]
    assert substrings.repeated_passages(empty).count() == 0
