import math
from collections import defaultdict
from hashlib import md5

from cohortlens.llm import mixing
from tests.llm.conftest import sentence


def corpus(spark, rng, sizes=(("a", 120), ("b", 30), ("c", 12), (None, 5))):
    rows = [(s, sentence(rng, rng.randrange(5, 40))) for s, n in sizes for _ in range(n)]
    rows = [(i, t, s) for i, (s, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4), rows


def hashed(*parts):
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def weights(tokens, e):
    total = sum(tokens.values())
    powers = {s: (t / total) ** e for s, t in tokens.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


def bisect(bad, good, holds):
    for _ in range(200):
        k = (bad + good) / 2
        bad, good = (bad, k) if holds(k) else (k, good)
    return good


def exponent(tokens, share, entropy, epochs):
    total = sum(tokens.values())

    def h(k):
        return -sum(v * math.log(v) for v in weights(tokens, k).values() if v)

    def repeats(k):
        w = weights(tokens, k)
        return max(share * total * w[s] / tokens[s] for s in w)

    goal = math.log(len(tokens)) * (1 if entropy is None else entropy)
    if len(tokens) < 2 or h(0) - h(64) < 1e-12:
        e = 1.0
    elif h(0) <= goal + 1e-12:
        e = 0.0
    else:
        e = 64.0 if h(64) > goal else bisect(0.0, 64.0, lambda k: h(k) <= goal)
    allowed = lambda k: epochs is None or repeats(k) <= epochs * (1 + 1e-12)
    return e if allowed(e) else bisect(e, 1.0, allowed)


def brute(rows, entropy, epochs, share=1.0):
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    share = min(share, epochs)
    e = exponent(tokens, share, entropy, epochs)
    w, out = weights(tokens, e), []
    for s in tokens:
        own = [(i, len(t.split()), md5(f"={i}\x1f={t}".encode()).hexdigest()) for i, t, x in rows if x == s]
        blocks, want = math.ceil(math.sqrt(len(own))), math.floor(w[s] * share * total + 0.5)
        passes, rest = want // tokens[s], want % tokens[s]
        out += [(i, e) for i, _, _ in own for e in range(passes)]
        last = sorted((hashed("block0", passes, k) % blocks, hashed("row0", passes, k), k, i, n) for i, n, k in own)
        for _, _, _, i, n in last if rest else []:
            rest -= n
            if rest < 0:
                break
            out.append((i, passes))
    return sorted(out)


def test_equals_brute_force(spark, rng):
    df, rows = corpus(spark, rng)
    for entropy, epochs, share in ((0.95, 4.0, 1.0), (0.6, 4.0, 1.0), (0.3, 9.0, 2.0), (1.0, 2.0, 1.0), (0.99, 3.0, 2.5), (0.1, 1.0, 5.0)):
        got = sorted((r["doc_id"], r["epoch"]) for r in mixing.mix(df, share, entropy, epochs).collect())
        assert got == brute(rows, entropy, epochs, share)


def test_blocks_are_interleaved_permutations(spark, rng):
    df, rows = corpus(spark, rng, (("a", 100), ("b", 100)))
    out = mixing.mix(df, 2.0, None, 4.0).collect()
    blocks = defaultdict(set)
    for r in out:
        blocks[r["source"], r["epoch"]].add((r["block"], r["block_order"]))
    assert all(len({b for b, _ in v}) == len(v) <= 10 for v in blocks.values())
    first = [r["doc_id"] for r in sorted(out, key=lambda r: (r["block_order"], r["row_order"])) if r["epoch"] == 0]
    again = [r["doc_id"] for r in sorted(out, key=lambda r: (r["block_order"], r["row_order"])) if r["epoch"] == 1]
    assert first != again and len(set(first)) == len(first)


def shares_of(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(t / total,) for t in tokens], "share double")


def test_temperature_meets_its_target(spark):
    """Flatter and steeper mixtures than the sources are; which targets cannot be met is told."""
    tokens = [700, 200, 90, 10]
    natural = -sum(t / 1000 * math.log(t / 1000) for t in tokens) / math.log(4)
    for target, flatter in ((0.95, True), (natural, None), (0.3, False), (0.05, False)):
        found = mixing.temperature(shares_of(spark, tokens), 1.0, target, None)
        assert found.met and abs(found.entropy - target) < 1e-9
        assert flatter is None or (found.exponent < 1) == flatter
        assert abs(found.exponent - exponent(dict(enumerate(tokens)), 1.0, target, None)) < 1e-9
    limited = mixing.temperature(shares_of(spark, tokens), 1.0, 1.0, 4.0)
    assert not limited.met and abs(limited.repeats - 4) < 1e-9 and 0 < limited.exponent < 1
    steep = mixing.temperature(shares_of(spark, tokens), 2.0, 0.05, 2.5)
    assert not steep.met and abs(steep.repeats - 2.5) < 1e-9 and steep.exponent > 1
    twins = mixing.temperature(shares_of(spark, [400, 400, 200]), 1.0, 0.5, None)
    assert not twins.met and twins.exponent == mixing.STEEPEST and abs(twins.entropy - math.log(2) / math.log(3)) < 1e-9
    alike = mixing.temperature(shares_of(spark, [5, 5, 5]), 1.0, 0.5, 4.0)
    assert alike.exponent == 1.0 and not alike.met and abs(alike.entropy - 1) < 1e-9 and abs(alike.repeats - 1) < 1e-9
    assert mixing.temperature(shares_of(spark, [5]), 1.0, 0.5, 4.0).exponent == 1.0
    assert mixing.temperature(shares_of(spark, tokens), 1.0, None, 8.0).exponent < mixing.temperature(shares_of(spark, tokens), 1.0, None, 2.0).exponent


def test_given_table_is_tempered(spark):
    """On the given documents the target moves the exponent, and the rows follow the weights."""
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    row = out.first()
    assert row["entropy_met"] and abs(row["exponent_micro"] - 1_000_000) > 10_000
    sums = {r["source"]: r["n"] for r in out.groupBy("source").sum("n_tokens").toDF("source", "n").collect()}
    total = sum(sums.values())
    reached = -sum(n / total * math.log(n / total) for n in sums.values()) / math.log(len(sums))
    assert abs(reached - 0.95) < 0.01 and out.filter("epoch > 0").count() > 0


def test_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs, 1.0, None, 1.0)
    assert out.count() == odd_docs.count()
    full = mixing.mixed_documents(odd_docs, 1.0, None, 1.0)
    assert full.columns == odd_docs.columns and full.filter("mix_key = 'mix_key' AND row = 'row'").count() == out.count()
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    silent = odd_docs.filter("doc_id IN (1, 2)")
    assert mixing.mix(silent).count() == 0


def test_no_python_in_the_plan(spark, rng):
    df, _ = corpus(spark, rng)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
