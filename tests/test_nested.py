"""Values of any depth against plain recursion."""

import json
import random

import pytest

from folio.operators import nested as N

ROWS = "k int, body string"


def refs(value):
    out = []
    if isinstance(value, dict):
        out += [str(value["ref_id"])] if "ref_id" in value and "quote" in value else []
        for v in value.values():
            out += refs(v)
    elif isinstance(value, list):
        for v in value:
            out += refs(v)
    return out


def cut(value, most):
    if isinstance(value, str):
        tokens = max(1, len(value) // 3)
        return value if tokens <= most else value[: max(1, int(len(value) * most / tokens * 0.97))] + "\n\n[truncated]"
    if isinstance(value, dict):
        return {k: cut(v, most) for k, v in value.items()}
    return [cut(v, most) for v in value] if isinstance(value, list) else value


def made(rng, depth=0):
    kind = rng.choice(["dict", "list", "text", "number", "null", "bool", "cite"] if depth < 6 else ["text", "number"])
    if kind == "dict":
        return {rng.choice(["z", "a", "é\"", "m.n", "x y", "{"]) + str(i): made(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == "list":
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == "cite":
        own = {"quote": rng.choice(["q", None, 3]), "ref_id": f"r{rng.randrange(9)}A\"{{}}", "more": made(rng, depth + 1)}
        return dict(rng.sample(sorted(own.items()), 3))
    return {"text": rng.choice(["", "short", "{\"not\": 1}", "[1]", "long 𝒜 text " * 5, "null", "\\ \n\t\""]), "number": rng.choice([1, -2.5, 10**12]), "null": None, "bool": True}[kind]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    return [[made(rng), made(rng), {"a": made(rng)}] for _ in range(60)] + [{"a": {"b": [{"c": {"d": {"ref_id": "deep", "quote": ""}}}]}}, [], {}, "x", 1]


def test_refs_in_order_at_any_depth(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{oops"), (901, None)], ROWS)
    got = {}
    for r in N.cited_refs(rows, "k", "body").orderBy("k", "n").collect():
        got.setdefault(r.k, []).append(r.ref_id)
    assert got == {i: refs(v) for i, v in enumerate(values) if refs(v)}


def test_every_string_is_cut_and_the_rest_stays(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{oops"), (901, None)], ROWS)
    got = {r.k: r.json for r in N.compacted(rows, "k", "body", 4).collect()}
    assert set(got) == set(range(len(values)))
    for i, v in enumerate(values):
        assert json.dumps(json.loads(got[i])) == json.dumps(cut(v, 4)), v  # dumps: the order of keys counts


def test_cutting_writes_and_shuffles_nothing(spark, monkeypatch):
    """Strings are cut where they stand; keys may repeat or be null, names that look like strings stay, what stands behind the value is not read."""
    monkeypatch.setattr(N, "written", lambda rows, name: pytest.fail("written"))
    long = "ab:\"c\\ " * 9
    told = cut(long, 4)
    texts = [(1, json.dumps({long: [long, {"a:": "b:"}]}, indent=2)), (1, json.dumps(long)), (None, json.dumps([[long], None, 1.5, True])), (2, f"[{json.dumps(long)} , 2 ] : [3"), (3, "[1"), (4, "[" * 300 + json.dumps(long) + "]" * 300)]
    made = N.compacted(spark.createDataFrame(texts, ROWS), "k", "body", 4)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    short = lambda v: json.dumps(v, separators=(",", ":"))
    want = [(1, short({long: [told, {"a:": "b:"}]})), (1, short(told)), (None, short([[told], None, 1.5, True])), (2, short([told, 2])), (4, "[" * 300 + short(told) + "]" * 300)]
    assert [tuple(r) for r in made.collect()] == want


def test_texts_of_blocks(spark):
    blocks = [
        {"type": "text", "content": "plain \r\n text "},
        {"type": "title", "content": {"title_content": [{"type": "text", "content": "Part "}, {"type": "inline_equation", "content": "$x_1$"}]}},
        {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "a "}, {"type": "interline_equation", "content": "y = 2"}, 3, None, {"spans": 1}]}},
        {"type": "equation", "content": {"math_content": "\\[ e = mc^2 \\]", "math_type": "latex"}},
        {"type": "note", "content": {"math_content": "$$z$$", "math_type": "display", "html": "<b>x</b>"}},
        {"type": "list", "list_items": ["one", "two"], "content": "no"},
        {"type": "table", "content": {}, "text": [], "table_body": "<table>", "latex": "no"},
        {"type": "image", "content": {"image_caption": [{"text": "Fig"}, {"value": {"html": " one"}}], "image_footnote": "foot"}},
        {"category": " Odd ", "content": [["in", {"content": ["si", {"latex": "de"}]}], " out"]},
        {"type": "text"},
        {"type": "text", "content": {"content": None, "html": {"text": None, "value": "v"}}},
    ]
    want = [
        "plain\n text", "Part $x_1$", "a $$\ny = 2\n$$3", "\\[ e = mc^2 \\]", "$$\nz\n$$\n<b>x</b>", "- one\n- two", "<table>", "Fig one\nfoot", "inside out", "", "v",
    ]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(blocks)], ROWS)
    got = {r.k: r.text for r in N.block_text(rows, "k", "body").collect()}
    assert [got[i] for i in range(len(blocks))] == want


def test_levels_follow_each_other_without_being_written(spark, monkeypatch):
    """Four levels are taken apart before anything is written, what lies deeper in as many rounds as it takes."""
    rounds, write = [], N.written
    monkeypatch.setattr(N, "written", lambda rows, name: rounds.append(name) or write(rows, name))
    cite = {"ref_id": {"ref_id": 1.5, "quote": 0}, "quote": None}
    for value, want, times in (({"a": [cite]}, ["", "1.5"], 1), ([[[[[{"b": cite}]]]]], ["", "1.5"], 2)):
        rounds.clear()
        made = N.cited_refs(spark.createDataFrame([(1, json.dumps(value))], ROWS), "k", "body")
        assert [r.ref_id for r in made.orderBy("n").collect()] == want and len(rounds) == times
