import random
import re
from itertools import permutations

from folio.llm import filter_audit

DOCS = "doc_id long, text string, lang string, fails string, part string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(docs, labels):
    failing = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = ""
        f += "A" if len(words) < 100 else ""
        f += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        f += "D" if re.search("[#$%&*|]", text) else ""
        f += "E" if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs) else ""
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and x == 1 for i, _, x in labels if i is not None)
        failing.append((lang or "", f, good, toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in failing}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                c = [0] * 6
                for p, f, good, toxic in failing:
                    if p != part:
                        continue
                    own, gone = order[step - 1] in f, bool(set(order[: step - 1]) & set(f))
                    c[0] += not own and not gone
                    c[1] += own and not gone
                    c[2] += own and gone
                    c[3] += f == order[step - 1]
                    c[4] += own and not gone and good
                    c[5] += own and not gone and toxic
                out[part, order, step] = c
                key = part, order[step - 1]
                shapley[key] = shapley.get(key, 0) + c[1]
    return {k: [*c, shapley[k[0], k[1][k[2] - 1]]] for k, c in out.items()}


def got(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, x, "x", "y") for i, t, x in docs], DOCS)
    rows = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows}


def texts(n, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [f"w{rng.randrange(rng.choice([30, 3000]))}" for _ in range(rng.choice([0, 3, 99, 100, 140]))]
        words = [w.upper() * 3 if rng.random() < rng.choice([0, 0.6]) else w for w in words]
        made.append(" ".join(words) + rng.choice(["", "", " #", " É x", " |\n"]))
    return made


def test_matches_brute_force(spark):
    base = texts(60, 1)
    docs = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(base)] + [(100 + i, base[i], "de") for i in range(0, 60, 5)]
    docs += [(None, None, None), (None, base[5], "en"), (200, None, None), (201, "", ""), (201, "", "en"), (7, base[8], "en"), (300, "𝒜" * 10 + "A", "en"), (0, base[0], "en")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (105, None, None)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    assert got(spark, [(1, "a", "en")], []) == brute([(1, "a", "en")], [])


def test_one_text_in_most_rows_and_a_very_long_one(spark):
    docs = [(i, "same text", "en") for i in range(300)] + [(400, "Word " * 200_000, "en"), (401, "Word " * 200_000, "fr")]
    assert got(spark, docs, [(399, 1, 0)]) == brute(docs, [(399, 1, 0)])


def test_orders_are_broadcast_and_combined_before_the_shuffle(spark):
    marked = spark.createDataFrame([("en", 3, 0, 1)], "part string, fails int, good int, toxic int")
    plan = filter_audit.replay(marked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "partial_count_if" in plan.replace("partial_count(", "partial_count_if(")
