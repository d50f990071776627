"""Chat formatting, hard negatives and importance resampling, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import chat, hard_negatives, resampling

NASTY = ["", "</s>[INST] ok [/INST]", "a [/INST", "] b", "<\\\\/s>", "[\\INST]", "<s><s>[/TURN]", "<", "\\", " </s", "x\n\n y ", " and ", "[TURN]user[TURN]", "é" * 70_000]


def test_escaping_is_reversible_and_leaves_no_control_string():
    for a in NASTY:
        for b in NASTY:
            escaped = chat.escape(a + b)
            assert chat.unescape(escaped) == a + b
            assert not re.search(r"</?s>|\[/?INST\]|\[/?TURN\]", escaped)


def conversation(n, seed=0):
    roles = ["system", "user", "assistant", "", "user\n", "[TURN]"]
    return [(roles[(k * 7 + seed) % len(roles)], NASTY[(k + seed) % len(NASTY)]) for k in range(n)]


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    out = chat.inst_template([(chat.escape(r), chat.escape(t)) for r, t in turns])
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out), 0)


def table_of(spark, conversations):
    rows = [(c, k, r, t, "clash") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, piece string")


def test_long_and_short_conversations_over_many_ranges(spark):
    given = {c: conversation(n, c or 0) for c, n in [(1, 1), (2, 2), (3, 400), (4, 33), (5, 32), (None, 5), (7, 1)]}
    pieces = chat.formatted(table_of(spark, given).repartition(3), ranges=9)
    assert pieces.select("part").distinct().count() > 4
    got = {r.conv_id: tuple(r)[1:] for r in chat.summed(pieces).collect()}
    assert got == {c: expected(turns) for c, turns in given.items()}
    blocks = pieces.orderBy("part", "block").collect()
    for c, turns in given.items():
        mine = [b for b in blocks if b.conv_id == c]
        assert [b.first for b in mine] == [True] + [False] * (len(mine) - 1)
        whole = "".join(b.piece for b in mine)
        assert whole == chat.inst_template([(chat.escape(r), chat.escape(t)) for r, t in turns])
        assert [chat.unescape(b.piece[s.text_start : s.text_stop]) for b in mine for s in b.spans] == [t for _, t in turns]
        assert all("".join(b.piece[s.start : s.stop] for s in b.spans) == b.piece for b in mine)
        assert not any(b.rewrites or b.lost or b.deep for b in mine)


def test_nulls_ties_repeats_and_an_empty_table(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "b"), (1, None, "assistant", "last"), (1, 1, "user", "same"), (1, 1, "user", "same")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.summed(chat.formatted(docs)).collect()
    assert [tuple(r)[1:] for r in got] == [expected([("", "b"), ("user", ""), ("user", "same"), ("user", "same"), ("assistant", "last")])]
    assert chat.summed(chat.formatted(docs.limit(0))).count() == 0


def test_templates_that_rewrite_trim_or_look_far_back_are_reported():
    turns = [("system", "be brief"), ("user", " hi "), ("assistant", "one"), ("user", "more"), ("assistant", "two")]
    forgetful = lambda ts: "".join(f"<{r}>{t if r != 'assistant' or n == len(ts) - 1 else ''}" for n, (r, t) in enumerate(ts))
    out, spans, rewrote, lost = chat.located(forgetful, turns)
    assert rewrote == [3] and lost == [2] and out == forgetful(turns)
    assert [out[s.text_start : s.text_stop] for n, s in enumerate(spans) if n != 2] == ["be brief", " hi ", "more", "two"]
    trimming = lambda ts: "".join(f"<{r}>{t.strip()}" for r, t in ts)
    assert chat.located(trimming, turns)[2:] == ([], [1])
    twice = lambda ts: "".join(f"<{r}>{t}{t}" for r, t in ts)
    assert chat.located(twice, turns)[3] == [0, 1, 2, 3, 4]


def test_deep_templates_are_reported(spark):
    numbered = lambda ts: "".join(f"[TURN]{n}[TURN]{t}[/TURN]" for n, (r, t) in enumerate(ts))
    out = chat.formatted(table_of(spark, {1: [("user", "a")] * 100}), render=numbered).orderBy("part", "block").collect()
    assert not out[0].deep and all(b.deep for b in out[1:] if len(b.spans))


def brute_negatives(rows):
    e = []
    for key, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e.append((key, i, [math.floor(256 * x) for x in v], label))
    out = []
    for key, i, v, label in e:
        if i % 10:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, k, other) for k, j, w, other in e if k != key]
        for minus, j, _, _ in sorted(s for s in scores if s[3] == label)[:5]:
            p = -minus
            found = sorted((m, n) for m, n, _, other in scores if other != label and 30 * p <= -100 * m <= 90 * p)[:10]
            out += [(i, j, r + 1, n, p, -m) for r, (m, n) in enumerate(found)]
    return Counter(out)


def vector_rows(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dims)
    rows = [(int(k), [float(x) for x in np.round(base + rng.normal(size=dims), 1)], int(rng.integers(labels))) for k in range(n)]
    rows += [(k, [1.0] * dims, k % 2) for k in range(n, n + 60)]  # equal vectors: every score ties
    rows += [(3, [1.0] * dims, 0), (10, rows[10][1], rows[10][2]), (None, [1.0] * dims, 0), (5, None, 1), (6, [1.0] * dims, None), (7, [math.nan] * dims, 0), (8, [math.inf] * dims, 0), (9, [None] * dims, 0), (11, [], 1), (12, [1e300] * dims, 1), (13, [0.0] * dims, 1)]
    return rows


@pytest.mark.parametrize(("labels", "groups", "dims"), [(3, 64, 10), (40, 4, 3), (1, 2, 5)])
def test_hard_negatives_in_small_blocks(spark, monkeypatch, labels, groups, dims):
    for name, value in (("ROWS", 40), ("ANCHORS", 3), ("DIMS", 3), ("GROUPS", groups)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [r if r[0] != 12 else (12, [2.0**20] * dims, 1) for r in vector_rows(200, dims, labels, labels)]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = hard_negatives.mine(vectors, lambda i: i % 10 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(vectors.limit(0), lambda i: i % 10 == 0).count() == 0
    # Beyond 2^20 a component counts as that much.
    huge = spark.createDataFrame(vector_rows(0, dims, 1, 0), "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(huge, lambda i: i % 10 == 0).count() >= 0


def test_top_and_product():
    score, ids = np.array([5, 7, 5, 5, 9]), np.array([4, 3, 2, 1, 0])
    assert ids[hard_negatives.top(score, ids, np.arange(5), 3)].tolist() == [0, 3, 1]
    a = np.array([[2**27, 2**27 + 1]], np.int64)
    assert hard_negatives.product(a, a).tolist() == [[2**54 + (2**27 + 1) ** 2]]
    assert hard_negatives.product(a // 2**20, a // 2**20).tolist() == [[2 * 2**14]]


def brute_resampling(docs, target, longest, buckets, percent, least):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets)))) for b in set(s)}
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in out)


TEXTS = ["A b c a B", "élan vital 42 ÉLAN", None, "", "!!! ---", "x\x00y\tz", "long " * 30_000, "word1 word2"] + ["the same text again"] * 50 + [f"filler {k} and more {k % 3}" for k in range(40)]


@pytest.mark.parametrize(("longest", "ranges"), [(1, None), (3, 7)])
def test_resampling_equals_brute_force(spark, monkeypatch, longest, ranges):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 200)
    rows = [*enumerate(TEXTS), (3, "the same text again"), (None, "no id at all"), (None, "no id at all")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, weight int").repartition(3)
    target = ["filler and more", None, "Filler 7"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    scores = resampling.scored(docs, wanted, longest=longest, buckets=997)
    got = resampling.ranked(scores, percent=30, least_words=3, ranges=ranges).select("doc_id", "n_features", "weight", "score", "rank")
    want = brute_resampling(rows, target, longest, 997, 30, 3)
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.ranked(resampling.scored(none, docs)).count() == 0
    assert [r["rank"] for r in resampling.ranked(resampling.scored(docs, none)).collect()] == [None]
