import random
import re
from hashlib import sha256

from cohortlens.llm.decontaminate import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = set()
    for item, text in items:
        w = words(text)
        windows |= {(item, tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12)) if w}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} if item is not None else set()
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a b c dd ee F ff 9 é ü".split()) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 40, 60])] + [(20, text(20)), (21, None), (22, "-- !"), (None, text(15))]
    items += [(23, items[7][1]), (7, text(13))]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(30)]
    for i in range(30, 60):
        part = words(rng.choice(items)[1])
        a = rng.randrange(0, max(1, len(part) - 5))
        docs.append((i, text(rng.randrange(30)) + ", " + "--".join(part[a : a + rng.randrange(3, 40)]).upper() + "! " + text(rng.randrange(30))))
    docs += [(60, docs[-1][1]), (60, docs[-1][1]), (None, docs[-1][1]), (61, None), (62, "")]
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert result(decontaminate(docs_df, items_df)) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text in two rows for a test of ties"), (2, " ".join(f"w{i}" for i in range(100, 160)))], "item_id int, text string")
    items = items.selectExpr("*", "'x' AS window", "'y' AS wid")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(decontaminate(odd_docs, items)) == brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert result(decontaminate(odd_docs, items.limit(0))) == brute(rows, [])
    assert decontaminate(no_docs, items).count() == 0


def test_no_python_in_the_plan(spark, odd_docs):
    items = spark.createDataFrame([(1, "same text in two rows for a test of ties")], "item_id int, text string")
    plan = decontaminate(odd_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_text_that_repeats_an_item(spark):
    """One long text full of one item, another of one word that is an item's only word, and items that overlap themselves."""
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(1, phrase), (2, "tick " * 20), (3, "tock"), (4, phrase.split(" ", 2)[2])]
    docs = [(1, f"{phrase} filler " * 2_000), (2, "tick " * 30_000), (3, "tock, " * 5_000), (4, "tick " * 12), (5, f"x {phrase} y")]
    found = {r[0]: r for r in result(decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))}
    assert [found[i][1:4] for i in range(1, 6)] == [(32_000, 30_000, 2), (30_000, 30_000, 1), (5_000, 5_000, 1), (12, 0, 0), (17, 15, 2)]


def test_rows_are_told_apart_by_128_bits(spark, odd_docs):
    items = spark.createDataFrame([(1, "same text in two rows for a test of ties")], "item_id int, text string")
    plan = decontaminate(odd_docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(md5" in plan and "xxhash64(doc_id" not in plan
