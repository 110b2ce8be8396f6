import json
import re

from quern.llm import toolcalls

SCHEMAS = {"add": {"fields": {"a": "number", "b": "number", "note": "string"}, "required": ["a", "b"], "open": False}, "any": {"fields": {}, "required": [], "open": True}}
ROWS = [
    (1, 0, "text", None, None, "hi\n\"quoted\""), (1, 1, "call", "x", "add", '{"b": 2, "a": 1.5}'), (1, 2, "call", "y", "add", '{"a": 1}'), (1, 3, "result", "y", None, None),
    (1, 4, "result", "x", None, "3.5"), (1, 5, "call", "x", "add", '{"a":1,"b":2,"c":3}'), (1, 6, "call", "z", "nope", "{}"), (1, 7, "call", "w", "add", "not json"),
    (1, 8, "call", "v", "add", "[1]"), (1, 9, "call", "u", "add", '{"a":"1","b":2}'), (1, 10, "call", "t", "any", '{"z":{"y":1,"b":[true,null]},"a":""}'), (1, 11, "result", "lost", None, "?"),
    (2, 3, "result", "x", None, "early"), (2, 5, "call", "x", "any", "{}"), (None, 0, "call", "x", "any", "{}"), (3, 0, "call", None, "any", ""), (4, 0, "text", None, None, ""), (4, 0, "text", None, None, ""),
]
SCHEMA = "conv_id long, turn long, kind string, call_id string, name string, body string"


def linked(spark, rows):
    return toolcalls.link(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SCHEMAS)


def test_links_order_and_faults(spark):
    got = sorted((tuple(r) for r in linked(spark, ROWS).collect()), key=repr)
    assert len(got) == len(ROWS)
    first = sorted(r for r in got if r[0] == 1)
    assert [r[2] for r in first] == [0, 1, 4, 2, 3, 5, 6, 7, 8, 9, 10, 11]  # results follow their calls
    assert [r[1] for r in first] == list(range(12))
    assert {r[2]: r[5] for r in first} == {0: "text", 1: "linked", 4: "linked", 2: "linked", 3: "linked", 5: "duplicate_id", 6: "unanswered", 7: "unanswered", 8: "unanswered", 9: "unanswered", 10: "unanswered", 11: "orphan"}
    assert {r[2]: r[6] for r in first if r[6]} == {2: "missing:b", 5: "unknown_field", 6: "unknown_tool", 7: "not_json", 8: "not_object", 9: "type:a"}
    assert [(r[2], r[1]) for r in sorted(r for r in got if r[0] == 2)] == [(5, 0), (3, 1)]
    assert [r[5] for r in got if r[0] is None] == ["unanswered"]
    assert sorted(r[1] for r in got if r[0] == 4) == [0, 1]


def test_json_is_canonical(spark):
    for r in linked(spark, ROWS).collect():
        value = json.loads(r["json"])
        assert list(value) == sorted(value)
        if r["error"] is None and r["kind"] == "call" and r["turn"] != 0:
            assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    text = next(r["json"] for r in linked(spark, ROWS[:1]).collect())
    assert json.loads(text) == {"content": 'hi\n"quoted"', "kind": "text"}


def test_empty_and_hot(spark):
    assert linked(spark, ROWS).limit(0).count() == 0
    assert toolcalls.link(spark, spark.createDataFrame([], SCHEMA), SCHEMAS).count() == 0
    hot = [(7, k, "call" if k % 2 == 0 else "result", f"c{k // 2}", "any", "{}") for k in range(4000)]
    got = linked(spark, hot).collect()
    assert sorted((r["turn"], r["position"]) for r in got) == [(k, k) for k in range(4000)]


def test_plan_runs_no_python(spark):
    plan = linked(spark, ROWS)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_calls_follow_what_they_need(spark):
    """A chain of 40 calls, each needing the next, comes out turned around, whatever the log's order."""
    rows = [(1, 2 * k, "call", f"c{k}", "any", "{}", f"c{k + 1}" if k < 39 else None) for k in range(40)]
    rows += [(1, 2 * k + 1, "result", f"c{k}", None, "r", None) for k in range(40)] + [(1, 50, "text", None, None, "between", None), (1, 100, "text", None, None, "end", None)]
    got = toolcalls.link(spark, spark.createDataFrame(rows, SCHEMA + ", after string").repartition(3), SCHEMAS).collect()
    place = {(r["turn"], r["kind"]): r["position"] for r in got}
    assert sorted(place.values()) == list(range(82))
    for k in range(39):
        assert place[2 * k + 2, "call"] < place[2 * k + 3, "result"] < place[2 * k, "call"] < place[2 * k + 1, "result"]
    assert place[50, "text"] < place[78, "call"] < place[0, "call"] < place[100, "text"]
    assert all(r["error"] is None for r in got)


def test_circles_and_unknown_references(spark):
    rows = [
        (1, 0, "call", "a", "any", "{}", "b"), (1, 1, "call", "b", "any", "{}", "c"), (1, 2, "call", "c", "any", "{}", "b"), (1, 3, "call", "d", "any", "{}", "d"),
        (1, 4, "call", "e", "any", "{}", "nowhere"), (1, 5, "call", "f", "any", "{}", "e"), (2, 0, "call", "g", "any", "{}", "a"), (None, 1, "call", "h", "any", "{}", "a"), (1, 6, "call", "i", "nope", "{}", "nowhere"),
    ]
    got = {r["call_id"]: r for r in toolcalls.link(spark, spark.createDataFrame(rows, SCHEMA + ", after string"), SCHEMAS).collect()}
    assert {k: r["error"] for k, r in got.items()} == dict.fromkeys("abcd", "circular_reference") | {"e": "unknown_reference", "f": None, "g": "unknown_reference", "h": None, "i": "unknown_tool"}
    assert [r["position"] for k, r in sorted(got.items()) if r["conv_id"] == 1] == list(range(7))
    assert json.loads(got["f"]["json"])["after"] == "e"


def test_other_columns_are_ignored(spark):
    names = ("call_turn", "answered", "owner_conv", "owner_call", "key", "status", "position", "at_", "part_", "ptr", "major", "json")
    rows = [(*r, *range(len(names))) for r in ROWS]
    more = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    assert sorted(map(repr, toolcalls.link(spark, more, SCHEMAS).collect())) == sorted(map(repr, linked(spark, ROWS).collect()))


def test_turns_become_calls(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", 'a "b"'), (1, 2, "assistant", None), (1, 3, "assistant", "more")]
    turns += [(k, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for k in range(2, 42) for t in range(8)]
    got = toolcalls.link(spark, toolcalls.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), toolcalls.REPLY).collect()
    first = {r["turn"]: r for r in got if r["conv_id"] == 1}
    # Conversation 1: two calls by one identifier, so results by fours.
    assert [first[k]["status"] for k in range(4)] == ["text", "unanswered", "orphan", "orphan"] or [first[k]["status"] for k in range(4)] == ["text", "linked", "linked", "linked"]
    errors = {r["error"] for r in got if r["error"]}
    assert errors == {"missing:role", "type:turn", "unknown_field", "unknown_tool", "not_json", "not_object", "unknown_reference", "circular_reference"}
    assert {r["status"] for r in got} == {"text", "linked", "duplicate_id", "orphan", "unanswered"}
    turned = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 10), key=lambda r: r["position"])]
    assert turned == [6, 7, 4, 5, 2, 3, 0, 1]
