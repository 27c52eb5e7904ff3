"""What the wire formats take and refuse, and that no text makes reading them fail otherwise."""

import json
import random
from decimal import Decimal
from urllib.parse import urlencode

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from winnow.functions import parsers
from winnow.model import FilterError, FilterRequest, Group, Leaf, SortItem
from winnow.operators import profiles as P
from winnow.plans.engine import FilterDefinition
from winnow.plans.schema import SchemaBuilder, prop
from winnow.sources import wire

#: Texts of each parameter that the wire format refuses.
REFUSED = {
    "where": ["{", "not json", "", "   ", "5", "[]", '"x"', "null", '{"field":"a","op":"isNull"} x', '{"field":"a","op":"isNull"}{"field":"b","op":"isNull"}', "{}", '{"field":"a"}', '{"and":[],"field":"a"}', '{"and":[5]}', '{"not":[]}', '{"and":[null]}', '{"or":[{"field":"a"}]}', '{"and":[],"or":[]}', '{"field":5,"op":"eq"}', '{"and":{}}', '{"field":"a","op":"eq","value":NaN}'],
    "sort": ["", "   ", ":desc", "  :asc", "name:up", "a:b", "name:"],
    "page": ["1.5", "abc", "", " ", "+", "+-5", "5-", "1 5", "\xa05", "٥", "2147483648", "-2147483649", "99999999999999999999", "9" * 5000],
    "pageSize": ["2e3", "0x10", "1,0"],
}


@pytest.mark.parametrize("name,text", [(k, x) for k, each in REFUSED.items() for x in each])
def test_refused_parameters(name, text):
    with pytest.raises(wire.WireError) as error:
        wire.from_query_string(urlencode([(name, text)]))
    assert error.value.parameter == name


def test_what_occurs_once():
    leaf = '{"field":"a","op":"isNull"}'
    for pairs, name in (([("where", leaf)] * 2, "where"), ([("page", "1"), ("Page", "2")], "page"), ([("pageSize", "1"), ("PAGESIZE", "1")], "pageSize"), ([("sort", "a"), ("sort", "")], "sort")):
        with pytest.raises(wire.WireError) as error:
            wire.from_query_string(urlencode(pairs))
        assert error.value.parameter == name


@pytest.mark.parametrize("request_", [
    {"page": 1}, {"page": 1, "pageSize": 20}, {"where": {"field": "tags", "op": "isEmpty"}},
    {"where": {"and": [{"field": "name", "op": "ilike", "value": "an%"}, {"field": "t", "op": "in", "value": []}]}},
    {"where": {"or": [{"and": [{"field": "on", "op": "eq", "value": True}, {"field": "n", "op": "gte", "value": 18}]}, {"not": [{"field": "a.b", "op": "isNull"}]}]}},
    {"where": {"field": "s", "op": "eq", "value": 'a b&c=d+e%f"g'}}, {"where": {"field": "s", "op": "contains", "value": "Київ🙂"}},
    {"where": {"field": "on", "op": "eq", "value": None}, "sort": [{"field": "a:b", "dir": "Desc"}, {"field": "n", "dir": "Asc"}, {"field": "x"}], "page": 2, "pageSize": 25},
])
def test_round_trips(request_):
    read = wire.decode(json.dumps(request_))
    again = wire.from_query_string(wire.to_query_string(read))
    assert again == read and wire.request_to(read) == request_


def test_digits_are_kept():
    text = '{"where":{"field":"a","op":"in","value":[0.10,12345678901234567890.123456789,{"x":[1.50]}]}}'
    read = wire.decode(text)
    assert read.where.value[:2] == [Decimal("0.10"), Decimal("12345678901234567890.123456789")]
    assert wire.encode(read) == text


def test_names_and_numbers_of_directions():
    item = lambda d: wire.decode(json.dumps({"sort": [{"field": "a", "dir": d}]})).sort[0].dir
    assert [item(x) for x in ("asc", "DESC", "Desc", 0, 1, 7, "7", None)] == [0, 1, 1, 0, 1, 7, 7, None]
    for bad in ("up", True, [], 1.5):
        with pytest.raises(wire.WireError):
            item(bad)


@pytest.mark.parametrize("text", ['{"sort":[{"field":5}]}', '{"sort":5}', '{"sort":[5]}', '{"page":true}', '{"page":"1"}', '{"pageSize":1.5}', "[]", '"x"', "1e999999999", "9" * 6000, "[" * 100_000, '{"where":' + '{"not":[' * 900 + '{"field":"a","op":"isNull"}' + "]}" * 900 + "}", '{"where":{"field":"\\ud800","op":"eq"}}', "\ud800"])
def test_refused_requests(text):
    with pytest.raises(wire.WireError):
        wire.decode(text)


def test_requests_that_cannot_be_written():
    deep = Leaf("a", "isNull")
    for _ in range(3):
        deep = Group("not", (deep,))
    assert wire.decode(wire.encode(FilterRequest(deep))).where.op == "not"
    for wrong in (FilterRequest(sort=(SortItem("a", 7),)), FilterRequest(sort=(SortItem("\ud800"),)), FilterRequest(Leaf("a", "eq", "\ud800")), FilterRequest(Leaf("a", "eq", float("nan"))), FilterRequest(Leaf("a", "eq", {1, 2})), FilterRequest("x"), FilterRequest(sort=(None,))):
        with pytest.raises(wire.WireError):
            wire.to_query_string(wrong)


def schema():
    out = SchemaBuilder("t").add(prop("b", P.BOOL))
    profiles = [P.STRING, P.BYTE, P.INT16, P.INT32, P.INT64, P.DECIMAL, P.SINGLE, P.DOUBLE, P.GUID, P.DATE_TIME, P.DATE_TIME_OFFSET, P.DATE_ONLY, P.TIME_ONLY, P.enum_profile("E", ["A", "B"])]
    return FilterDefinition(out.add(*(prop(f"c{i}", p) for i, p in enumerate(profiles))))


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text() | st.sampled_from(["0001-01-01T00:00:00+02:00", "9999-12-31T23:00:00-02:00", "2024-02-30", "24:00", "1e400", "9" * 5000, "NaN", "Infinity"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=2), max_leaves=6)
NODES = st.recursive(st.builds(lambda f, o, v: {"field": f, "op": o, "value": v}, st.sampled_from(["b", *(f"c{i}" for i in range(14)), "zz"]), st.sampled_from(["eq", "ne", "in", "gt", "contains", "isNull", "zz"]), VALUES) | VALUES, lambda x: st.builds(lambda k, c: {k: c}, st.sampled_from(["and", "or", "not"]), st.lists(x, max_size=3)), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.sampled_from(["where", "sort", "page", "pageSize", "Page", "x"]), NODES | VALUES, max_size=4))
def test_any_request_gives_a_result_or_an_error_of_this_library(data):
    try:
        schema().validate(wire.decode(json.dumps(data)))
    except FilterError:
        pass


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from('{}[]":,\\ adnorwhefilsortpagSz0159.-+eE%&=u8\ud800é'), max_size=60))
def test_any_text_gives_a_request_or_an_error_of_this_library(text):
    for read in (wire.decode, wire.from_query_string):
        try:
            read(text)
        except FilterError:
            pass


def test_every_type_refuses_what_it_cannot_hold():
    every = [parsers.int32, parsers.decimal, parsers.single, parsers.double, parsers.guid, parsers.date_time, parsers.date_time_offset, parsers.date_only, parsers.time_only]
    rng = random.Random(1)
    for parse in every:
        for text in ("0001-01-01T00:00:00+02:00", "9999-12-31T23:00:00-02:00", "", "-", "+", ".", "1e", "\x00", "9" * 400, "".join(rng.choice("0123456789-:TZ+.") for _ in range(20))):
            try:
                parse(text)
            except parsers.ParseError:
                pass
