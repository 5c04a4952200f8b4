"""Decontamination, license scan and tool-call linking against brute force, with edge cases."""

import hashlib
import re

import pytest

from tesselar.llm import chat, decontaminate, licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


ITEM = "the quick brown fox jumps over one lazy dog and then it sleeps well under a Tree"
DOCS = [
    (1, f"intro {ITEM.upper()} outro " + "w " * 10),
    (2, None),
    (3, ""),
    (4, "x " * 3000 + ITEM),
    (5, "Short Item"),
    (5, "Short Item"),
    (6, "éé Ünder short item, SHORT-ITEM again"),
    (7, ITEM + " " + ITEM),
    (None, ITEM),
    (8, "...!?"),
]
ITEMS = [(10, ITEM), (9, ITEM), (11, "short item"), (12, None), (13, "")]


def brute(text, items):
    w, win = words(text), {}
    for i, t in items:
        v = words(t)
        k = min(13, len(v))
        for j in range(len(v) - k + 1 if v else 0):
            win.setdefault(tuple(v[j : j + k]), set()).add(str(i))
    hit, ids = set(), set()
    for key, got in win.items():
        for j in range(len(w) - len(key) + 1):
            if tuple(w[j : j + len(key)]) == key:
                hit |= set(range(j, j + len(key)))
                ids |= got
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_contamination(spark, limit):
    docs = spark.createDataFrame([(*r, 5) for r in DOCS], "doc_id long, text string, k int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, limit=limit).collect()
    have = sorted(((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got), key=repr)
    assert have == sorted(((i, brute(t, ITEMS)) for i, t in DOCS), key=repr)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t in DOCS if not brute(t, ITEMS)[4]), key=repr)
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert spans[1] == "intro outro " + " ".join(["w"] * 10) and spans[8] == "...!?" and spans[2] is None


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).first().n_hit == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. Under the Apache license version 2!",
    "Licensed under CC BY-NC 4.0.",
    "nothing here: mit license? no. mit mit mit",
    "This work is licensed under the GNU General Public License, version 3.",
    "ALL RIGHTS RESERVED",
    None,
    "",
    "x " * 4000 + "under the mit license",
    "license version 2 apache under mit",
]


def test_license_scan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, base = words(t), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            base += [(j, label) for j in range(len(w)) if w[j : j + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None)
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and {x for _, x in base} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert [got[i].labels for i in (0, 3, 4, 5, 6, 9)] == ["mit", "", "gpl-3", "all-rights-reserved", "", ""]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_templates_of_a_table(spark):
    own = spark.sql("SELECT * FROM VALUES (array('a', 'rare', 'phrase', 'of', 'ours'), 1, 2, 'own', false), (array('of', 'of'), 0, 2, 'twice', true) AS t(words, key, n_key, label, base)")
    texts = ["a rare phrase of ours", "rare phrase", "such a rare phrase of", "of of of", "rare rare phrase of ours", None]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    got = sorted((r.n_words, r.labels, r.n_base, r.score) for r in licenses.scan(docs, templates=own).collect())
    assert got == sorted([(5, "own", 0, 1.0), (5, "own", 0, 1.0), (2, "", 0, 0.0), (5, "own", 0, 0.8), (3, "twice", 2, 1.0), (5, "own", 0, 0.8), (0, "", 0, 0.0)])
    assert {r.labels for r in licenses.scan(docs, templates=own.limit(0)).collect()} == {""}


def test_chat_linking(spark):
    calls = [
        ("a", "f", '{"y": 2, "x": "q"}', []),
        ("b", "f", '{"x": 5, "z": {"k": 1, "a": [2, 1]}}', ["a"]),
        ("c", "g", "no json", ["b", "a", "?"]),
        ("d", "f", None, ["e"]),
        ("e", "f", '{"x": ""}', ["d"]),
        (None, "f", '{"x": ""}', []),
    ]
    c = spark.createDataFrame(calls, "call_id string, name string, arguments string, on_ids array<string>")
    r = spark.createDataFrame([("a", 'said "hi"\n'), ("z", None)], "call_id string, content string")
    schema = {"f": {"properties": {"x": {"type": "string"}, "y": {"type": "integer", "maximum": 1}}, "required": ["x"], "additionalProperties": False}}
    got = {r.call_id: r for r in chat.link(c, r, schema).collect()}
    assert {k: (v.status, v.level) for k, v in got.items()} == {"a": ("linked", 0), "b": ("open", 1), "c": ("open", 2), "d": ("open", None), "e": ("open", None), "z": ("orphan", None), None: ("open", 0)}
    assert got["a"].errors == ["y: maximum"] and got["b"].errors == ["additional properties", "x: type"] and got["c"].errors == ["unknown tool"] and got["e"].errors == []
    assert got["a"].json == '{"arguments":{"x":"q","y":2},"call_id":"a","name":"f","result":"said \\"hi\\"\\n"}'
    assert got["b"].json == '{"arguments":{"x":5,"z":{"a":[2,1],"k":1}},"call_id":"b","name":"f","result":null}'
    assert '"arguments":"no json"' in got["c"].json and got["z"].json.startswith('{"arguments":null')
    assert "not an object" in got["d"].errors
