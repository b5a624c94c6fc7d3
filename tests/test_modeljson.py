import json

import pytest

from corpusql.functions import modeljson as mj

ENTITIES = '{"entities":[{"attributes":{"a":1},"confidence":0.9}]}'

REPLIES = [
    (f"```json\n{ENTITIES}\n```", json.loads(ENTITIES), 0),
    (f"```\n{ENTITIES}```", json.loads(ENTITIES), 0),
    (ENTITIES, json.loads(ENTITIES), 0),
    (f"Here: {ENTITIES} thanks", json.loads(ENTITIES), 1),
    (f"A long preamble that is longer than any offset. {ENTITIES}", json.loads(ENTITIES), 1),
    ('{"a":1,}', {"a": 1}, 2),
    ("{'a':'b'}", {"a": "b"}, 2),
    ('{"a":"", "b":1,}', {"a": "", "b": 1}, 2),
    ('{"u":"http://x.y/z", "t":"10:30",}', {"u": "http://x.y/z", "t": "10:30"}, 2),
    ('{"a":1 // note\n}', {"a": 1}, 2),
    ('{"a":1 /* note */}', {"a": 1}, 2),
    ('{a: 1, b_2: "x"}', {"a": 1, "b_2": "x"}, 2),
    ('{"it":"isn\'t",}', {"it": "isn't"}, 2),
    ('[{"a":1} {"a":2}]', [{"a": 1}, {"a": 2}], 2),
    ('{"a":"x"\n"b":"y"}', {"a": "x", "b": "y"}, 2),
    ('[{"a":1},{"a":2}]', [{"a": 1}, {"a": 2}], 0),
    ('List: [{"a":1},{"a":2}] done', [{"a": 1}, {"a": 2}], 1),
    ('[note] {"a":1}', {"a": 1}, 1),
    ('[see] {"a":[1]} [end]', {"a": [1]}, 1),
    ('Both: {"a":1},{"a":2}.', [{"a": 1}, {"a": 2}], 1),
    ('{"a":[{"b":1},{"b":2}]}', {"a": [{"b": 1}, {"b": 2}]}, 0),
    ("Numbers: [1, 2] ok", [1, 2], 1),
    ('{"meta": @@, "entities": [{"attributes":{"a":1}}]} tail', {"entities": [{"attributes": {"a": 1}}]}, 3),
    ("not JSON", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("reply,want,level", REPLIES)
def test_reply(column, reply, want, level):
    got, = column([reply], mj.parse_reply)
    assert got["repair_level"] == level
    assert (None if got["json"] is None else json.loads(got["json"])) == want


def entities(column, text):
    got, = column([text], mj.entity_list)
    return [(dict(e["attributes"]), e["confidence"]) for e in got or []]


def test_entities_from_every_shape(column):
    one = '{"attributes":{"a":1,"b":null,"c":"x"},"confidence":0.9}'
    want = [({"a": "1", "b": None, "c": "x"}, 0.9)]
    assert entities(column, f'{{"entities":[{one}]}}') == want
    assert entities(column, f"[{one}]") == want
    assert entities(column, f"{one},{one}") == want * 2
    assert entities(column, '{"a":1}') == []
    assert entities(column, None) == []
