"""What fuzzy line dedup computes for many lines at once, against plain versions."""

import random
from collections import Counter

import numpy as np
import pandas as pd

from evidentia.llm import line_dedup


def test_lines_in_stretches():
    """Sets of many lines are those of each alone, and what the ends of two lines have alike never makes dissimilar ones similar."""
    rng = random.Random(11)
    lines = ["".join(rng.choices("ab é\U0001f600", k=rng.choice([1, 9, 10, 11, 40]))) for _ in range(400)] + ["\udc80" * 30, "x" * 3000]
    sets = line_dedup.shingle_sets(lines)
    strings = [line_dedup.shingle_strings(x) for x in lines]
    assert [len(s) for s in sets] == [len(s) for s in strings] and all((s[1:] > s[:-1]).all() for s in sets)
    assert len({s.tobytes() for s in sets}) == len({frozenset(s) for s in strings})
    assert all(s.tolist() == line_dedup.shingle_sets([x])[0].tolist() for s, x in zip(sets, lines))
    sure = Counter()
    for x in lines + ["ab" * 40, "abc" * 100, "".join(rng.choices("abcdefgh", k=300))] * 5:
        for _ in range(20):
            at, size = rng.randrange(len(x)), rng.randrange(12)
            y = x[:at] + "".join(rng.choices("abé", k=rng.randrange(4))) + x[at + size :] or "z"
            one, two = line_dedup.shingle_strings(x), line_dedup.shingle_strings(y)
            sure[line_dedup.surely_similar(x, len(one), y), line_dedup.similar(one, two)] += 1
    assert not sure[True, False] and sure[True, True] > 100 and sure[False, False] > 100


def test_signatures_of_lone_lines_stay_behind(spark, monkeypatch):
    """A signature that one line alone has, be it signed by several tasks, isn't sent on to be sorted by rows; all others are."""
    rng = random.Random(12)
    lines = ["".join(rng.choices("abcdefgh", k=60)) for _ in range(60)]
    lines += [x[:-1] + "z" for x in lines[:20]] + lines[40:50]
    texts = [(i, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]
    sigs = {line_dedup.number(x): line_dedup.bands([x])[0][0].astype(np.int64).tolist() for x in lines}
    held = Counter(s for x in sigs.values() for s in x)
    want = {(s, rep) for rep, x in sigs.items() for s in x if held[s] > 1}
    sent, plain = [], line_dedup.linked_parts
    monkeypatch.setattr(line_dedup, "linked_parts", lambda postings, *rest: sent.append(postings) or plain(postings, *rest))
    dropped = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).agg({"n_dropped": "sum"}).first()[0]
    got = [(r["sig"], r["rep"]) for r in sent[0].collect()]
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < len(sigs) * line_dedup.BANDS and dropped == 30


def test_too_many_signatures_for_a_task(monkeypatch):
    """A task that may not hold its ranges passes every signature on."""
    rng = np.random.default_rng(13)
    table = np.zeros(300, line_dedup.SIGNED)
    table["rep"], table["n"], table["sigs"] = np.arange(300), 7, rng.integers(0, 1 << 63, (300, line_dedup.BANDS)) * 2
    table["sigs"][1::50] = table["sigs"][::50]
    every = {(s, r) for r, x in zip(table["rep"].tolist(), table["sigs"].astype(np.int64).tolist()) for s in x}
    shared = {(s, r) for s, r in every if r % 50 < 2}
    for run, most, want in ((1 << 18, 1 << 18, shared), (40, 1 << 18, shared), (40, 100, every)):
        monkeypatch.setattr(line_dedup, "RUN", run)
        monkeypatch.setattr(line_dedup, "MOST", most)
        signed = [pd.DataFrame({"signed": [table[i : i + 3].tobytes(), b""]}) for i in range(0, 300, 3)]
        ranges = pd.concat(line_dedup._ranges(8)(iter(signed)))
        assert set(ranges["part"]) == set(range(8))
        met = pd.concat(line_dedup._met(ranges.iloc[i : i + 5] for i in range(0, len(ranges), 5)))
        assert set(zip(met["sig"], met["rep"])) == want and set(met["n"]) == {7}
    assert not list(line_dedup._ranges(8)(iter([]))) and not list(line_dedup._met(iter([])))


def test_many_and_few_lines_with_company(spark, monkeypatch):
    """Whether lines that meet others are few enough to broadcast changes nothing; places of other lines aren't looked for if so."""
    rng = random.Random(14)
    lines = ["".join(rng.choices("abcdefgh", k=60)) for _ in range(30)]
    texts = [(i, f"{lines[i]}\n\n{lines[i % 4]}z\n") for i in range(30)] + [(30, None), (31, ""), (32, "\n")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = []
    for few in (True, False):
        monkeypatch.setattr(line_dedup, "is_small", lambda *_, few=few: few)
        found.append(sorted(line_dedup.dedup_lines(df).collect()))
    assert found[0] == found[1]
    assert [r["n_lines"] for r in found[0]] == [4] * 30 + [0, 1, 2] and [r["n_dropped"] for r in found[0]] == [1] * 30 + [0, 0, 0]
