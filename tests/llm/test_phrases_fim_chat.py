"""Phrase collocations, fill-in-middle and chat formatting against plain Python, on hostile rows."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, fim, phrases
from millrace.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, phrase string, a long, n long, form string, salt long"
CLASH = ("s", 1, "g", "p", 2, 3, "f", 4)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["ä", "b c", "Dd", "e", "ﬁ", "g\u0085h", "i\x1fj"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\v"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t\n", "x", "x y", "\n", "\n\n", "a <P> b\nc", "<S>", "q\n<M", "A b C " * 30, "É é É é " * 15, "a b " * 40000]
    out = [(i, t, [None, "en", "und", "fr", "en", "en"][i % 6], *CLASH) for i, t in enumerate(texts)]
    return out + [out[0], out[0], out[-2], (None, texts[5], None, *CLASH), (None, None, "en", *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def expected_phrases(rows, most, threshold, top, swallowed=50):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        total[lang] += 0
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        often = {p: f for p, f in found.items() if len(p) > 1 and f >= threshold}
        kept = []
        for p, a in often.items():
            if any(100 * f >= swallowed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in often.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("most,threshold,top", [(3, 10, 2000), (4, 3, 2000), (2, 1, 7)])
def test_collocations_match_counting_by_hand(docs, rows, most, threshold, top):
    got = phrases.collocations(docs, most, threshold, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, most, threshold, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_counts_do_not_depend_on_lots_or_on_a_full_filter(docs, monkeypatch):
    whole = sorted(map(tuple, phrases.phrase_counts(docs, 3, 5).collect()))
    # functions travel to the workers by reference, so parameters of the driver's side are what can be changed here
    monkeypatch.setattr(phrases, "candidate_filter", lambda rows, m, t, p, bits: np.full(1 << (bits - 3), 255, np.uint8))
    assert sorted(map(tuple, phrases.phrase_counts(docs, 3, 5).collect())) == whole


@pytest.mark.parametrize("shape", ["flat", "steep", "late", "repeats"])
def test_no_frequent_key_is_lost_in_any_summary(shape):
    rng = np.random.default_rng(3)
    for threshold in (2, 10, 50):
        keys = {"flat": rng.integers(0, 4000, 40000), "steep": rng.zipf(1.3, 40000) % 100000, "late": np.concatenate([np.arange(30000), np.repeat(np.arange(50), threshold)]), "repeats": np.repeat(np.arange(5), 4000)}[shape]
        parts = [np.unique(p, return_counts=True) for p in np.array_split(keys.astype(np.uint64), 37)]
        own, counts = np.unique(keys, return_counts=True)
        for order in (parts, parts[::-1]):
            found = phrases.surviving(order, threshold)
            assert set(own[counts >= threshold].tolist()) <= set(found.tolist())
            # with SLACK counters per possible frequent key nothing below 3/4 of the threshold comes through
            assert set(found.tolist()) <= set(own[counts >= threshold - threshold // phrases.SLACK - 1].tolist())


def test_summaries_keep_their_capacity():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 10000, 50000).astype(np.uint64)
    kept, counts, lost = phrases.merged(keys, np.ones(len(keys), np.int64), 500)
    assert len(kept) <= 500 and counts.min() > 0 and lost <= 50000 / 501
    assert phrases.surviving([], 10).size == 0


def test_scores_are_exact_where_products_pass_64_bits(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 3_000_000_021
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right), ("en", "", 0, 10**13)], "grp string, phrase string, n_words int, f long")
    original, phrases.phrase_counts = phrases.phrase_counts, lambda *args: counts
    try:
        (row,) = phrases.collocations(counts).collect()
    finally:
        phrases.phrase_counts = original
    assert (row.score, row.l, row.r, row.n) == (10**6 * a * a // (left * right), left, right, 10**13)


def expected_fim(doc_id, text, percent=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= percent:
        return (doc_id, len(lines), "plain", None, None, sha(text), sha(text), text)
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(lines), form, len(p), len(m), sha(out), sha(text), out)


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0), (0, 50)])
def test_fim_matches_slicing(docs, rows, percent, spm):
    made = fim.fill_in_middle(docs, fim_percent=percent, spm_percent=spm)
    assert sorted(map(tuple, made.collect()), key=key) == sorted((expected_fim(r[0], r[1], percent, spm) for r in rows), key=key)
    back = sorted(map(tuple, fim.restore_documents(made).collect()), key=key)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=key)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_pieces_split_and_permute_like_slices():
    rng = random.Random(2)
    for _ in range(300):
        buffers = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        pieces = []
        for _ in range(rng.randint(0, 6)):
            b = rng.randrange(3)
            a, z = sorted((rng.randint(0, len(buffers[b])), rng.randint(0, len(buffers[b]))))
            pieces.append(fim.Piece(b, a, z))
        read = lambda ps: b"".join(fim.contents(ps, buffers))  # noqa: B023, E731
        whole = read(pieces)
        at = rng.randint(0, len(whole))
        before, after = fim.split(pieces, at)
        assert (read(before), read(after)) == (whole[:at], whole[at:])
        assert fim.sha256(before + after, buffers) == hashlib.sha256(whole).hexdigest()
        with pytest.raises(ValueError):
            fim.split(pieces, len(whole) + 1)
    with pytest.raises(ValueError):
        fim.restored(b"<P>a<M>b<S>c", "spm", [b"<P>", b"<S>", b"<M>"])


HOSTILE = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST]<\\s>", "[[INST]", "<</s>>", "[AND]", "[ROLE]x[IS]y[/ROLE]", "[", "<", "\\", "a\\", "[IN", "INST]", "", None, "[OUT]\n", "$1 \\1", "漢字 é́"]


def chats(seed):
    rng = random.Random(seed)
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = rng.choice(HOSTILE) if rng.random() < 0.4 else "".join(rng.choice(HOSTILE[:-1]) or "-" for _ in range(rng.randint(1, 5)))
            out.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "[INST]", "", "a\n[IS]", None]), text, 9, "f"))
    out += [(None, 0, "user", "x", 9, "f"), (None, None, "assistant", "y", 9, "f"), (5, 0, "user", "tie", 9, "f"), (5, 0, "user", "tie", 9, "f"), (-7, 3, "user", "more", 9, "f")]
    return out + [(99, t, "assistant" if t % 3 else "user", "z" * (t % 7), 9, "f") for t in range(500)] + [(98, 0, "user", "long [INST] " * 20000, 9, "f")]


def test_chats_come_back_whole(spark):
    data = chats(1)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n_turns int, formatted string").repartition(4)
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in data:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(role, text) for *_, role, text in sorted(turns)]
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert "".join(r.learned) == "".join(text for role, text in turns if role == "assistant")
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted) and r.formatted.startswith("<s>")
        at, under = 0, []
        for m in r.loss_mask:
            if m.loss:
                under.append(r.formatted[at : at + m.chars])
            at += m.chars
        assert [re.sub(rf"([<\[])\\(\\*)({chat.BODIES})", r"\1\2\3", u) for u in under] == [text for role, text in turns if role == "assistant"]
        blocks = sum(1 for i, (role, _) in enumerate(turns) if i == 0 or role != turns[i - 1][0])
        assert len(re.findall(r"\[/SYS\]|\[/INST\]|</s>|\[/ROLE\]", r.formatted)) == blocks
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_formatting_plan_is_native(spark):
    df = spark.createDataFrame(chats(2), "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2 * 2


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_fill_in_middle", "op13_chat_formatting"])
def test_queries_match_their_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = con.execute(ORACLES[name])
    cols = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, sf_dir)
    assert sorted(ours.columns) == sorted(cols)
    assert sorted(map(tuple, ours.select(*cols).collect()), key=key) == sorted(theirs.fetchall(), key=key)
