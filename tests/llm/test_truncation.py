import random

import numpy as np
import pytest

from choralis.llm import truncation as T

NOUNS = ["lantern", "meadow", "railway", "thunder", "compass", "harbor", "kitchen", "violin", "orchard", "captain", "ribbon", "shadow"]
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, h bigint, level int"


def line(rng):
    a, b = rng.choice(NOUNS), rng.choice(NOUNS)
    return rng.choice([f"Sing it to the {a}, sing it slowly", f"She kissed the {a} and never said why", f"Who sold the {a}, who followed the {b}, who cares", f"We were the {a} beyond the {b}"])


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    rows, cut = [], set()
    for i in range(1500):
        text = "\n".join(line(rng) for _ in range(rng.randint(4, 30)))
        source = "limited" if i % 3 == 0 else "free"
        if source == "limited" and len(text) > 500:
            text = text[:500]
            cut.add(i)
        elif source == "free" and i % 20 == 1:
            text = text[: int(len(text) * rng.uniform(0.4, 0.95))]
            # A cut that falls behind a whole line can't be seen.
            whole = text.split("\n")[-1]
            cut.add(i) if not (whole.endswith(("slowly", "why", "cares")) or whole == "" or whole.split()[-1] in NOUNS) else None
            if i not in cut:
                text = text.rsplit("\n", 1)[0]
        rows.append((i, text, source, None, 1, 1))
    rows += [(5000, None, "free", None, 1, 1), (5001, "", "free", 3, 1, 1), (5002, " \n ", "limited", 3, 1, 1), (5003, "One more harbor", None, None, 1, 1), (5004, "\n".join(line(rng) for _ in range(9000)), "free", None, 1, 1)]
    return {r["doc_id"]: r for r in T.judge(spark.createDataFrame(rows, SCHEMA)).collect()}, cut


def test_finds_cuts(judged):
    got, cut = judged
    found = {i for i, r in got.items() if r["cut"]}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95


def test_limit_is_fitted(judged):
    got, cut = judged
    assert all(got[i]["at_limit"] for i in cut if i % 3 == 0) and not any(r["at_limit"] for i, r in got.items() if i % 3 and i < 1500)


def test_blank_texts_are_left_out(judged):
    got, _ = judged
    assert not {5000, 5001, 5002} & set(got) and not got[5004]["cut"]


def test_censored_fit_finds_the_parameters():
    rng = np.random.default_rng(2)
    x = np.round(np.exp(rng.normal(6, 0.5, 20_000)))
    x = np.minimum(x, 500)
    length, n = np.unique(x, return_counts=True)
    mu, sd, *_ = T.fit(length, n.astype(float), [(500, 0)])
    assert abs(mu - 6) < 0.03 and abs(sd - 0.5) < 0.03


def histogram(x, source="s"):
    import pandas as pd

    length, n = np.unique(x, return_counts=True)
    return pd.DataFrame({"source": source, "unit": "chars", "length": length.astype(int), "n": n})


def test_longer_texts_hide_no_limit():
    """Of a source with a limit, some later texts exceed it; a second limit came later."""
    rng = np.random.default_rng(4)
    x = np.round(np.exp(rng.normal(6, 0.5, 2_400)))
    mixed = np.concatenate([np.minimum(x[:2000], 500), x[2000:2060]])
    assert T.fit_source(histogram(mixed))["limit"].tolist() == [500]
    raised = np.concatenate([np.minimum(x[:1200], 400), np.minimum(x[1200:], 700)])
    assert sorted(T.fit_source(histogram(raised))["limit"]) == [400, 700]
    assert T.fit_source(histogram(x)).empty


def test_limits_of_long_texts_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.minimum(np.round(np.exp(rng.normal(11, 0.4, 3_000))), 70_001).astype(int)
    rows = [("s", int(n), int(n), i, i) for i, n in enumerate(x)]
    got = T.limits(spark.createDataFrame(rows, "source string, chars bigint, bytes bigint, r bigint, t bigint")).collect()
    assert {r["limit"] for r in got} == {70_001}


def test_empty(spark):
    assert T.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.rates(T.judge(spark.createDataFrame([], SCHEMA))).collect() == []
