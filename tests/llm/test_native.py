"""Chat windows, exact dedup, mixing and shards: small cases with nulls, ties, repeats, empties and clashing columns."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from evidentia.llm import chat, common, exact_dedup, mixing, sharding

DOCS = "doc_id long, text string, source string, h long, id long"
ROWS = [
    (1, "Hello World", "b", 9, 9), (2, "hello world", "a", 9, 9), (2, "hello world", "a", 9, 9), (3, None, None, 9, 9), (4, "", "b", 9, 9),
    (5, "ÄÖ x", "a", 9, 9), (6, "äö x", None, 9, 9), (None, "hello world", "b", 9, 9), (7, "w " * 60_000, "b", 9, 9), (8, "  \t\n", "c", 9, 9),
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_exact_groups(spark):
    got = [r.asDict() for r in exact_dedup.exact_groups(spark.createDataFrame(ROWS, DOCS), capacity=2).collect()]
    assert len(got) == len(ROWS)
    group = [r for r in got if r["text_sha256"] == sha("hello world")]
    assert {r["keep_id"] for r in group} == {2} and {r["group_size"] for r in group} == {4}
    assert sum(r["kept"] for r in group) == 1 and next(r for r in group if r["kept"])["doc_id"] == 2
    assert {r["keep_id"] for r in got if r["text_sha256"] == sha("")} == {4}
    assert len({r["text_sha256"] for r in got}) == len([r for r in got if r["kept"]]) == 6  # Ä and ä differ
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    kept = exact_dedup.drop_copies(spark.createDataFrame(ROWS, DOCS))
    assert kept.columns == ["doc_id", "text", "source", "h", "id"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8]


def test_exact_groups_whose_hashes_collide_and_hot_ones(spark):
    """Four hashes for all texts: chains of many entries, told apart by bytes; and hashes dealt over several owners."""
    rows = [(i, f"text {i % 40}", "s", 0, 0) for i in range(200)]
    for heavy in (common.HEAVY, 7):
        old, exact_dedup.HEAVY, common.HEAVY = common.HEAVY, heavy, heavy
        try:
            hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(4))
            got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), capacity=8, hashed=hashed).collect()
        finally:
            exact_dedup.HEAVY = common.HEAVY = old
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, 160 + i % 40, 5, i >= 160) for i in range(200)}
        assert len(got) == 200 and max(r["chain"] for r in got) >= 10


def test_directory_doubles_where_buckets_are_overfull(spark):
    entries = spark.range(500).select(F.xxhash64("id").alias("h"))
    even = exact_dedup.grow_directory(entries, 16)
    assert even.place(entries).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16 and not even.splits
    skewed = spark.range(500).select(F.shiftrightunsigned(F.xxhash64("id"), 9).alias("h"))  # nine leading bits are 0
    d = exact_dedup.grow_directory(skewed, 16)
    assert d.place(skewed).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16 and d.splits
    same = spark.range(50).select(F.lit(7).cast("long").alias("h"))
    assert exact_dedup.grow_directory(same, 16).place(same).select("bucket").distinct().count() == 1


def test_exact_groups_of_hashes_with_one_prefix(spark):
    rows = [(i, f"text {i % 150}", "s", 0, 0) for i in range(300)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), capacity=4, hashed=lambda c: F.shiftrightunsigned(F.xxhash64(c), 12)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, 150 + i % 150, 2, i >= 150) for i in range(300)}


def test_a_large_directory_stays_out_of_the_plan(spark):
    """Many overfull buckets: their codes are in tables."""
    rows = [(i, f"text {i}", "s", 0, 0) for i in range(3000)]
    hashed = lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(3000)), 50)
    df = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), capacity=1, hashed=hashed)
    plan = df._jdf.queryExecution().toString()
    assert df.count() == 3000 and " IN (" not in plan and "INSET" not in plan


def test_shards(spark):
    rng = random.Random(1)
    rows = ROWS + [(i, "é" * rng.randint(0, 300), "s", 0, 0) for i in range(10, 300)]
    got = [r.asDict() for r in sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    total = sum(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    start, slots = 0, {}
    for r in order:  # the same cuts, one row after another
        s = min(7, (2 * start + r["size"]) * 8 // (2 * total))
        slots[s] = slots.get(s, -1) + 1
        assert r["shard"] == s and sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
        start += r["size"]
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def fill(sizes, most=3):
    """Targets by turns: cap those above, share their excess, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(2)
    rows = ROWS + [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "dd", "e", "f"]), 0, 0) for i in range(10, 200)]
    df = spark.createDataFrame(rows, DOCS)
    got = [r.asDict() for r in mixing.curriculum(df).collect()]
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = fill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["first_position"] is None or 0 <= r["first_position"] <= 1
    for s in sizes:
        assert sum(r["taken"] for r in got if r["source"] == s) == int(want[s])
    again = mixing.curriculum(df.repartition(3)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"], r["source"] or "")
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    near = {}
    for r in mixed.collect():
        near[r["source"]] = near.get(r["source"], 0) + len((r["text"] or "").split())
    for s in sizes:
        longest = max(len((r[1] or "").split()) for r in rows if r[2] == s)
        assert abs(near.get(s, 0) - want[s]) <= longest / 2 + 1
    assert mixing.curriculum(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_the_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "some words", "a", 1, 2) for i in range(5)], DOCS).selectExpr("*", "1 AS p_id", "2 AS p_md5", "3 AS p_nth", "4 AS start")
    got = mixing.mix(df)
    assert got.columns == df.columns and {(r["p_id"], r["p_md5"], r["p_nth"], r["start"]) for r in got.collect()} == {(1, 2, 3, 4)}


def test_targets_when_nothing_has_a_size(spark):
    got = mixing.curriculum(spark.createDataFrame([(1, None, "a", 0, 0), (2, "", None, 0, 0)], DOCS)).collect()
    assert [r["taken"] for r in got] == [0, 0]


TURNS = "conv_id long, turn long, role string, text string, pos long, ck string"


def told(turns):
    """What a conversation says, turn by turn."""
    key = lambda t: (t[1] is not None, t[1] or 0, (t[2] or "").encode(), (t[3] or "").encode())
    turns = sorted(turns, key=key)
    loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
    return len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)), len(loss), sha(loss)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["\\", "#", "###", "</turn>", "\n", "### Assistant: ", "é", " word", "\n</turn>\n", "\\n"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool\n###:", None]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(0, 30)))]), 5, "x") for c in range(12) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "hi", 5, "x"), (99, None, "user", "late", 5, "x"), (99, 3, "assistant", "a", 5, "x"), (99, 3, "assistant", "a", 5, "x")]
    rows += [(100, i, "assistant" if i % 2 else "user", "token " * rng.randint(0, 90), 5, "x") for i in range(300)] + [(101, 0, "assistant", "long " * 5000, 5, "x")]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), window_tokens=200, history_tokens=40)
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == {c: told([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    long = windows.where("conv = 100").withColumn("n", chat.token_count(F.col("formatted"))).collect()
    assert len(long) > 20 and sum(r["n_new"] for r in long) == 300 and any(r["n_context"] for r in long)
    escaped = spark.createDataFrame([("a###b</turn>####\\h",)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t")))).first()
    assert "###" not in escaped[0] and "</turn>" not in escaped[0] and escaped[1] == "a###b</turn>####\\h"
    assert chat.format_windows(spark.createDataFrame([], TURNS)).count() == 0


def test_windows_keep_their_budget(spark):
    """6,000 turns without text and 1,000 short ones, some without a turn number: no window holds more tokens than it may."""
    rows = [(1, i if i % 7 else None, "user", "" if i < 6000 else "some words", 0, "") for i in range(7000)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), window_tokens=512, history_tokens=64)
    got = windows.select("n_new", chat.token_count(F.col("formatted")).alias("n")).collect()
    assert sum(r["n_new"] for r in got) == 7000 and max(r["n"] for r in got) <= 512


def test_windows_with_a_long_system_turn(spark):
    """Beside system turns of 900 tokens and more windows keep their budget while a turn fits; beyond, every turn has its own."""
    rows = [(c, 0, "system", "rule " * n, 0, "") for c, n in enumerate((900, 700, 1015, 2000, 0))]
    rows += [(c, i, "assistant" if i % 2 == 0 else "user", f"t{i} w w w w", 0, "") for c in range(5) for i in range(1, 120)]
    rows += [(9, i, "user", "w " * 5, 0, "") for i in range(50)]
    df = spark.createDataFrame(rows, TURNS)
    windows = chat.format_windows(df).withColumn("n", chat.token_count(F.col("formatted"))).collect()
    by = {}
    for w in windows:
        by.setdefault(w["conv"], []).append(w)
    assert all(w["n"] <= 1024 for c in (0, 1, 4, 9) for w in by[c]) and all(w["n_new"] == 1 for w in by[3])
    assert all(w["formatted"].startswith("### system") for c in (0, 1, 2, 3) for w in by[c])
    assert any(w["n_context"] > 1 for w in by[1]) and all(w["n_context"] <= 1 for w in by[0])
    assert {c: sum(w["n_new"] for w in ws) for c, ws in by.items()} == {0: 120, 1: 120, 2: 120, 3: 120, 4: 120, 9: 50}
    small = chat.format_windows(df, window_tokens=40, history_tokens=256).collect()  # a window under the history
    assert sum(w["n_new"] for w in small) == 650


def test_system_turn_stays_and_history_is_masked(spark):
    rows = [(1, 0, "system", "be kind", 0, "")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i} " + "w " * 30, 0, "") for i in range(1, 20)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), window_tokens=200, history_tokens=70).collect()
    assert len(windows) > 1 and all(w["formatted"].startswith("### system\nbe kind\n</turn>\n") for w in windows)
    for w in windows:
        assert sum(s["length"] for s in w["loss"]) <= len(w["formatted"])
        for s in w["loss"]:
            assert w["formatted"][s["start"] :].startswith("t")
