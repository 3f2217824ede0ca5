import itertools
import random

import pytest
from pyspark.sql import functions as F

from recallgrid.llm import mixing as M
from recallgrid.llm import packing as P
from tests.oracle import rows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens int, partial string, epoch int, block_rank string, shuffle_key double, mix_source string"


def docs(spark, items):
    """items: (doc_id, text, source); extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "x", 1, "r", 0.5, "m") for i, t, s in items], SCHEMA)


def best_bins(items, c):
    """Least number of bins by dynamic programming over subsets."""
    n = len(items)
    best = [(0, c)] + [(n + 1, 0)] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        for i in range(n):
            if m >> i & 1:
                k, used = best[m ^ 1 << i]
                best[m] = min(best[m], (k, used + items[i]) if used + items[i] <= c else (k + 1, items[i]))
    return best[-1][0]


def test_reduction_keeps_the_least_number_of_bins():
    rng = random.Random(5)
    for _ in range(250):
        c = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, c) for _ in range(rng.randint(1, 10))]
        counts = {s: items.count(s) for s in items}
        fixed, rest = P.reduce_instance(counts, c)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (best_bins(left, c) if left else 0) == best_bins(items, c)


def test_best_fit_is_item_by_item_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(200):
        c = rng.choice([10, 30, 100])
        items = [rng.randint(1, c) for _ in range(rng.randint(1, 40))]
        bins = []
        for s in sorted(items, reverse=True):
            fit = [b for b in bins if c - sum(b) >= s]
            min(fit, key=lambda b: c - sum(b)).append(s) if fit else bins.append([s])
        kinds = P.best_fit({s: items.count(s) for s in items}, c)
        assert sorted(sum(k) for n, content in kinds for k in itertools.repeat([s * q for s, q in content], n)) == sorted(map(sum, bins))


def test_the_schedule_of_a_table_with_its_own_column_names(spark):
    d = docs(spark, [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(40)])
    got = M.mix_schedule(d)
    assert got.columns == ["doc_id", "source", "epoch", "block_rank", "shuffle_key"] and got.count() >= 40


def test_every_token_has_one_place(spark):
    items = [(i, "w " * (i * 7 % 23 + 1), "s") for i in range(120)] + [(None, "a b", "s"), (200, None, "s"), (201, "", "s"), (202, "x " * 2000, "s"), (5, "again and again", "s"), (5, "again and again", "s")]
    items += [(None, "a b c", "s")] * 4 + [(300, "w " * 64, "s")]
    got = P.pack(docs(spark, items).repartition(3), capacity=16, shard_rows=7).collect()
    want = sum(len(t.split()) for _, t, _ in items if t)
    assert sum(r.piece_tokens for r in got) == want and not {r.doc_id for r in got} & {200, 201}
    by = {}
    for r in got:
        by.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.piece_tokens))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 16
    assert sorted(by) == list(range(len(by)))
    assert len({(r.doc_id, r.copy_no) for r in got if r.doc_id == 5}) == 3 and {r.copy_no for r in got if r.doc_id is None} == set(range(5))
    assert len({(r.doc_id, r.copy_no, r.piece_no) for r in got}) == len(got) and len({r.bin_id for r in got if r.piece_tokens == 16}) == sum(r.piece_tokens == 16 for r in got)
    assert P.pack(docs(spark, [(1, "x", "s")]).where("false")).count() == 0


def test_exponent():
    t = {"a": 900, "b": 90, "c": 10}
    a = M.exponent(t, target_entropy=1.0)
    assert abs(M.entropy(M.weights(t, a)) - 1.0) < 1e-9
    assert M.exponent(t, target_entropy=9) == 0.0 and M.exponent(t, target_entropy=0.1) == 1.0
    a = M.exponent(t, max_repeat=3.0)
    w = M.weights(t, a)
    times = [w[s] / t[s] for s in t]
    assert abs(max(times) / min(times) - 3) < 1e-6
    m = M.plan_mix(t, max_repeat=3.0)
    assert m.budgets["a"] == 900 and m.budgets["c"] == 30
    assert M.plan_mix({}).budgets == {}


def mixed_by_hand(items, block_tokens, max_repeat):
    import hashlib

    h = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:15], 16)
    tok = lambda t: len(t.split()) if t else 0
    by = {}
    for i, t, s in items:
        by.setdefault(s or "", []).append((h("doc", "" if i is None else i), i, tok(t)))
    sums = {s: sum(x[2] for x in v) for s, v in by.items()}
    mix = M.plan_mix(sums, max_repeat=max_repeat)
    out = []
    for s, v in by.items():
        n = max(1, -(-sums[s] // block_tokens))
        budget, epoch = mix.budgets.get(s, 0), 0
        while epoch == 0 or budget > 0:
            order = sorted({x[0] % n for x in v}, key=lambda b: (h("block", s, epoch, b), b))
            for rank, b in enumerate(order):
                inside = sorted((x for x in v if x[0] % n == b), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
                size = sum(x[2] for x in inside)
                if sums[s] and budget <= 0:
                    break
                used = 0
                for k, grp in itertools.groupby(inside, key=lambda x: x[:2]):
                    grp = list(grp)
                    used += sum(x[2] for x in grp)
                    if size <= budget or not sums[s] or used <= budget:
                        out += [(x[1], epoch, rank, x[0]) for x in grp]
                budget -= size
            epoch += 1
    return out


def test_mix_against_a_plain_loop(spark):
    items = [(i, "w " * (i % 5 + 1), f"s{min(i % 9, 3)}") for i in range(90)] + [(7, "w w", None), (None, "w", "s1"), (300, None, "s2"), (301, "", "only-empty"), (9, "w", "s0"), (9, "w", "s0")]
    d = docs(spark, items)
    got = M.mixed(d, block_tokens=20, max_repeat=2.5)
    assert got.columns == [*d.columns, "epoch_", "block_rank_", "shuffle_key_"] and {(r.epoch, r.block_rank, r.shuffle_key, r.mix_source) for r in got.collect()} == {(1, "r", 0.5, "m")}
    k = lambda r: tuple((x is None, x or 0) for x in r)
    assert M.mixed(d.select("doc_id", "text", "source")).columns[3:] == ["epoch", "block_rank", "shuffle_key"]
    assert sorted([(r.doc_id, r.epoch_, r.block_rank_, r.shuffle_key_) for r in got.collect()], key=k) == sorted(mixed_by_hand(items, 20, 2.5), key=k)
    assert M.mixed(d.where("false")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_mix_is_the_same_whatever_the_partitioning(spark, shuffled):
    items = [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(40)]
    d = docs(spark, items)
    assert rows(M.mixed(d.repartition(7) if shuffled else d, block_tokens=10).toPandas()) == rows(M.mixed(d.orderBy(F.desc("doc_id")), block_tokens=10).toPandas())
