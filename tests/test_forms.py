"""Real-form predicate, profiles, cleaning and flattening against small plain-Python versions."""

import json

import pytest
from pyspark.sql import functions as F

from webjourney.functions import forms
from webjourney.operators import quality, summaries

REAL = [
    (None, False), ("", False), ("{}", False), ("[1]", False), ("not json", False),
    ({"form_values": {"email": "a@b.c"}}, True), ({"values": {"Company": "x"}}, True),
    ({"form_values": {}, "values": {"name": "x"}}, True), ({"form_values": {}, "filled_fields": 3}, False),
    ({"form_values": [1], "filled_fields": 3}, False), ({"form_values": {"query": "x", "email": "y"}}, False),
    ({"form_values": {"events": "x", "timestamp": "1"}}, False), ({"form_values": {"events": "[object Object]"}}, False),
    ({"form_values": {"data": "eyJx"}, "filled_fields": 1}, False), ({"form_values": {"data": "x" * 201}, "filled_fields": 1}, False),
    ({"form_values": {"data": "short"}, "filled_fields": 1}, True), ({"form_values": {"a": "eyJ" + "x" * 300}, "filled_fields": 1}, False),
    ({"form_values": {"a": "eyJ" + "x" * 300, "b": "1"}, "filled_fields": 1}, True),
    ({"form_values": {"field": "1"}, "filled_fields": 1}, True), ({"form_values": {"field": "1"}}, False),
    ({"form_values": {"user_email": "x"}, "timingsV2": 1}, False), ({"form_values": {"email": 'say "data": x'}}, False),
    ({"form_values": {"email": "x" * 5001}}, False), ({"form_values": {"message": None}}, True),
    ({"form_values": {"work_mail": "x"}}, False), ({"form_values": {"the_name_field": "x"}}, True),
]


def payload(v):
    return json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else v


def test_is_real_form(spark):
    df = spark.createDataFrame([(i, payload(v)) for i, (v, _) in enumerate(REAL)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(forms.is_real_form(F.col("p"))).collect()]
    assert got == [w for _, w in REAL]


def test_profile_takes_first_in_payload_order(spark):
    cases = [
        ({"form_values": {"z_name": "Zed", "email": "no-at", "work_mail": " a@b.c ", "full": "Later"}}, ("a@b.c", "Zed")),
        ({"form_values": {"username": "", "user": "u", "email": None}}, (None, "u")), (None, (None, None)),
    ]
    df = spark.createDataFrame([(i, payload(v)) for i, (v, _) in enumerate(cases)], "i int, p string")
    got = [tuple(r[0]) if r[0] else (None, None) for r in df.orderBy("i").select(forms.profile(F.col("p"))).collect()]
    assert got == [w for _, w in cases]


def test_best_profile_prefers_newest_work_address(spark):
    rows = [
        ("a", 1, "x@corp.example", "W1"), ("a", 2, "y@corp.example", None), ("a", 3, "p@gmail.com", "P"),
        ("b", 1, "p1@gmail.com", "P1"), ("b", 2, "p2@yahoo.com", "P2"), ("c", 1, None, "N"),
    ]
    events = spark.createDataFrame(
        [(c, i, payload({"form_values": {k: v for k, v in (("email", e), ("name", n)) if v}})) for c, i, e, n in rows],
        "client_id string, id long, event_data string").selectExpr(
        "*", "timestamp_seconds(id) AS timestamp", "'form_submit' AS event_type", "'u' AS page_url", "'/p' AS path")
    visits = spark.createDataFrame([], "id long, client_id string, timestamp timestamp, path string, page_url string, "
                                       "referrer string, source string, medium string, campaign string")
    wide = summaries.client_summaries(visits, events)
    got = {r.client_id: (r.email, r.name) for r in summaries.leads(wide).collect()}
    # The newest work form has no name, so the newest form's name stands in.
    assert got == {"a": ("y@corp.example", "P"), "b": ("p2@yahoo.com", "P2"), "c": (None, None)}
    first = {r.client_id: r.email for r in summaries.journeys(summaries.client_summaries(visits, events, "first")).collect()}
    assert first == {"a": "x@corp.example", "b": "p1@gmail.com", "c": None}


def test_clean_form_events_keeps_types_and_order(spark):
    cases = [
        ({"a": 1, "form_values": {"x": " ok\u0001 ", "n": 5, "bad": "日本語", "none": None, "o": {"k": [1]}}},
         {"a": 1, "form_values": {"x": "ok", "n": 5, "o": {"k": [1]}}}, True),
        ({"form_values": {"x": "ok", "n": 5}, "z": True}, None, False),
        ({"field_name": "q", "field_value": "\u0001"}, {"field_name": "q", "field_value": None}, True),
        ({"field_name": "q", "field_value": " v "}, {"field_name": "q", "field_value": "v"}, True),
        ({"other": 1}, None, False),
    ]
    df = spark.createDataFrame([(i, payload(v)) for i, (v, _, _) in enumerate(cases)], "id int, event_data string").withColumn(
        "event_type", F.lit("form_input"))
    got = quality.clean_form_events(df).orderBy("id").collect()
    for (before, after, changed), r in zip(cases, got):
        assert r.changed == changed
        assert json.loads(r.event_data) == (after or before)
        assert list(json.loads(r.event_data)) == list(after or before)
    totals = quality.clean_form_totals(df).first()
    assert (totals.cleaned, totals.unchanged, totals.total) == (3, 2, 5)


def flatten(obj, prefix="", out=None):
    out = {} if out is None else out
    items = obj.items() if isinstance(obj, dict) else ((str(i), v) for i, v in enumerate(obj))
    for k, v in items:
        key = f"{prefix}.{k}" if prefix else k
        if any(s in key.lower() for s in ("phc_", "distinct_id", "anonymous", "token", "uuid", "session_id", "timestamp",
                                          "version", "api_key", "device_id")):
            continue
        if isinstance(v, str):
            if "pass" not in key:
                out[key] = v.strip()
        elif isinstance(v, bool):
            out[key] = str(v).lower()
        elif isinstance(v, (int, float)):
            out[key] = str(v)
        elif v is not None and (len(prefix.split(".")) < 3):
            flatten(v, key, out)
    return dict(list(out.items())[:50])


@pytest.mark.parametrize("obj", [
    {"b": "x", "a": {"z": 1, "y": {"q": {"deep": "v", "deeper": {"no": 1}}}}, "t": True, "n": None},
    {"list": [1, "two", {"three": 3}], "token": "hidden", "user": {"password": "p", "name": " N "}},
    {f"k{i}": i for i in range(70)},
])
def test_flatten_payload(spark, obj):
    df = spark.createDataFrame([(1, json.dumps(obj))], "id long, event_data string")
    got = [(r.key, r.value) for r in quality.flatten_events(df).orderBy("position").collect()]
    assert got == list(flatten(obj).items())


def test_set_fields_in_place(spark):
    from webjourney.functions.jsontext import quoted, set_fields

    df = spark.createDataFrame([('{"b":"\\"q\\"","country":"XX","n":1.50,"o":{"k":null}}',)], "p string")
    got = df.select(set_fields(F.col("p"), {"country": quoted(F.lit("DE")), "city": quoted(F.lit('B"n'))})).first()[0]
    assert json.loads(got) == {"b": '"q"', "country": "DE", "n": 1.5, "o": {"k": None}, "city": 'B"n'}
    assert list(json.loads(got)) == ["b", "country", "n", "o", "city"]
