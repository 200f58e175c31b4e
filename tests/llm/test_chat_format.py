import json

import duckdb

from orrery.llm.chat_format import ORACLE_SQL, TOOLS, canonical, format_chat, op6_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, kind string, level int"
WEATHER = {
    "type": "object",
    "required": ["city"],
    "additionalProperties": False,
    "properties": {"city": {"type": "string", "minLength": 2, "enum": ["Rome", "Oslo", "X"]}, "days": {"type": "integer", "minimum": 1, "maximum": 7}, "opts": {"type": "object", "required": ["u"], "properties": {"u": {"type": "boolean"}, "f": {"type": "number"}}}},
}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = op6_chat_format(spark, d)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(ORACLE_SQL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(map(tuple, rows), key=repr)
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(want.select(*columns).fetchall())


def tagged(**call):
    return f"<tool_call>{json.dumps(call)}</tool_call>"


def test_tagged_calls_and_schemas(spark):
    bad = {
        "a": ({"city": "Rome", "days": 3, "opts": {"u": True, "f": 1.5}}, ""),
        "b": ({"days": 0}, "arguments: lacks city; arguments.days: less than 1"),
        "c": ({"city": "X", "days": 9, "z": 1}, "arguments: has further members; arguments.city: shorter than 2; arguments.days: more than 7"),
        "d": ({"city": 5, "days": "2", "opts": {"u": "no"}}, "arguments.city: not of type string; arguments.city: none of the values listed; arguments.days: not of type integer; arguments.opts.u: not of type boolean"),
        "e": ([1], "arguments: not an object"),
    }
    text = "Let me see. " + " ".join(tagged(id=k, name="weather", arguments=v[0]) for k, v in bad.items()) + tagged(id="f", name="none", arguments={}) + "<tool_call>{oops</tool_call>"
    after = tagged(id="g", name="weather", arguments={"city": "Oslo"}, after="a") + tagged(id=8, name="weather", arguments={"city": "Oslo"}, after="g") + tagged(id="p", name="weather", arguments={"city": "Oslo"}, after="q") + tagged(id="q", name="weather", arguments={"city": "Oslo"}, after="p")
    rows = [(1, 0, "user", "go", "k", 1), (1, 1, "assistant", text, "k", 1), (1, 2, "tool", '<tool_result>{"id": "a", "content": {"b": 1, "a": [2]}}</tool_result>\n<tool_result>{"id":"zz"}</tool_result>', None, 1), (1, 3, "assistant", after, "k", None)]
    got = {(r.kind, r.call_id): r for r in format_chat(spark.createDataFrame(rows, SCHEMA), TOOLS | {"weather": WEATHER}).collect() if r.part}
    for k, (args, errors) in bad.items():
        r = got["call", f"c-1-{k}"]
        assert sorted(r.errors.split("; ")) == sorted(errors.split("; ")) and r.valid == (not errors) and r.linked == (k == "a") and r.level == 0
        assert r.json == json.dumps({"arguments": args, "id": f"c-1-{k}", "name": "weather", "type": "call"}, sort_keys=True, separators=(",", ":"))
    assert got["call", "c-1-f"].errors == "unknown tool" and got["call", None].errors.startswith("not an object")
    assert got["result", "c-1-a"].linked and got["result", "c-1-a"].level == 1 and json.loads(got["result", "c-1-a"].json)["content"] == '{"a":[2],"b":1}'
    assert not got["result", "c-1-zz"].linked
    assert got["call", "c-1-g"].level == 1 and got["call", "c-1-8"].level == 2
    assert got["call", "c-1-p"].level is None and got["call", "c-1-q"].errors == "cycle"


def test_edges(spark):
    rows = [(None, 0, "user", "a", None, None), (2, None, "assistant", "b", None, None), (3, 0, "user", None, None, None), (3, 1, "assistant", None, None, None), (3, 1, "assistant", None, None, None), (3, 2, None, "", None, None), (3, 9, "user", "é\"\\\n\t/" + "y" * 50000, None, None)]
    rows += [(7, i, "user" if i % 2 else "assistant", str(i), "x", 1) for i in range(300)]
    got = format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[None, 0].call_id is None and by[None, 0].level is None and not by[None, 0].linked
    assert by[2, None].level is None and by[3, 0].errors == "arguments: lacks text" and by[3, 0].linked
    assert sum(r.conv_id == 3 and r.turn == 1 and r.linked and r.level == 1 for r in got) == 2
    assert by[3, 9].level == 0 and json.loads(by[3, 9].json)["arguments"]["text"].startswith('é"\\\n\t/y') and not by[3, 9].valid
    assert all(by[7, i].level == i for i in range(300))
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical(spark):
    rows = [('{"b": 1, "a": {"d": [1, 2.50, "x"], "c": null}}',), ("[1,",), (None,), ('"a"',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(canonical("t")).collect()]
    assert got == ['{"a":{"c":null,"d":[1,2.5,"x"]},"b":1}', None, None, '"a"']


def brute(rows, tools):
    """Events, levels, links and JSON of integer conversations, one event after another."""
    import re

    found = []
    for conv, turn, role, text in rows:
        here, before = f"t-{conv}-{turn}", f"t-{conv}-{turn - 1}"
        kind = {"user": "call", "assistant": "result"}.get(role, "note")
        call = {"call": here, "result": before}.get(kind)
        args = {k: v for k, v in (("text", text), ("turn", turn)) if v is not None}
        found.append(dict(conv=conv, turn=turn, part=0, kind=kind, event=here, call=call, waits=before, name="reply", args=args, content=text))
        for part, m in enumerate(re.finditer(r"(?s)<(tool_call|tool_result)>(.*?)</\1>", text or ""), 1):
            body = json.loads(m[2])
            told = lambda x: x.replace("%", "%25").replace("-", "%2D")
            name = f"c-{conv}-{told(body['id'])}"
            if m[1] == "tool_call":
                found.append(dict(conv=conv, turn=turn, part=part, kind="call", event=name, call=name, waits=f"c-{conv}-{told(body['after'])}" if "after" in body else None, name=body["name"], args=body["arguments"], content=None))
            else:
                found.append(dict(conv=conv, turn=turn, part=part, kind="result", event="r" + name[1:], call=name, waits=name, name=None, args=None, content=body.get("content")))
    waits = {}
    for e in found:
        if e["waits"] is not None or e["event"] not in waits:
            old = waits.get(e["event"])
            waits[e["event"]] = e["waits"] if old is None else min(old, e["waits"])

    def level(x):
        seen, n = {x}, 0
        while waits[x] in waits:
            x, n = waits[x], n + 1
            if x in seen:
                return None
            seen.add(x)
        return n

    calls, results = ({e["call"] for e in found if e["kind"] == k} for k in ("call", "result"))
    out = []
    for e in found:
        wrong = []
        if e["kind"] == "call":
            spec = tools.get(e["name"])
            if spec is None:
                wrong.append("unknown tool")
            else:
                wrong += [f"arguments: lacks {k}" for k in spec["required"] if k not in e["args"]]
                wrong += ["arguments: has further members"] * (spec.get("additionalProperties", True) is False and bool(set(e["args"]) - set(spec["properties"])))
                if "text" in e["args"] and e["name"] == "reply" and not e["args"]["text"]:
                    wrong.append("arguments.text: shorter than 1")
        at = level(e["event"])
        if at is None:
            wrong.append("cycle")
        body = {"id": e["call"], "type": e["kind"]} | ({"arguments": e["args"], "name": e["name"]} if e["kind"] == "call" else {"content": e["content"]})
        text = json.dumps({k: v for k, v in body.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        linked = e["call"] in (results if e["kind"] == "call" else calls) if e["call"] is not None and e["kind"] != "note" else False
        out.append((e["conv"], e["turn"], e["part"], e["kind"], e["call"], at, linked, not wrong, "; ".join(wrong), text))
    return out


def test_tagged_conversations_equal_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    for conv in range(60):
        ids = [f"{rng.choice('ab')}{rng.choice(['', '-', '%', '-b'])}{i}" for i in range(rng.randrange(1, 7))]
        for turn in range(rng.randrange(1, 6)):
            parts = [rng.choice(["", "so", "well "])]
            for _ in range(rng.randrange(4)):
                i = rng.choice(ids)
                if rng.random() < 0.6:
                    call = {"id": i, "name": rng.choice(["weather", "reply", "none"]), "arguments": rng.choice([{"city": "Oslo"}, {"days": 2}, {"text": "x", "turn": 1}, {}])}
                    if rng.random() < 0.6:
                        call["after"] = rng.choice(ids)
                    parts.append(tagged(**call))
                else:
                    parts.append(f'<tool_result>{json.dumps({"id": i, "content": rng.choice(["ok", "é"])}, ensure_ascii=False)}</tool_result>')
            rows.append((conv, turn + (turn > 2), rng.choice(["user", "assistant", "tool", None]), "".join(parts)))
    tools = TOOLS | {"weather": WEATHER}
    got = format_chat(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), tools).collect()
    order = lambda xs: sorted(((*x[:8], "; ".join(sorted(x[8].split("; "))), x[9]) for x in map(tuple, xs)), key=repr)
    assert order(got) == order(brute(rows, tools))
    assert sum(r.linked for r in got) > 50 and any(r.errors == "cycle" for r in got)


def test_names_of_texts_are_told_apart(spark):
    rows = [("a", 0, "user", tagged(id="b-c", name="none", arguments={})), ("a-b", 0, "user", tagged(id="c", name="none", arguments={})), ("a%2Db", 0, "user", tagged(id="c", name="none", arguments={}))]
    got = format_chat(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert len({r.call_id for r in got}) == 6
