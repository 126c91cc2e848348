"""Frontmatter in the forms of YAML, and its canonical text."""

import json
import random

import pytest

from notelake.sources import markdown, yaml


def test_forms():
    assert yaml.loads('tags: ["b, c", d]') == {"tags": ["b, c", "d"]}
    assert yaml.loads("links:\n  - {target: x, rel: y}") == {"links": [{"target": "x", "rel": "y"}]}
    assert yaml.loads("title: foo # note") == {"title": "foo"} and yaml.loads("title: a#b") == {"title": "a#b"}
    assert yaml.loads("a: {x: 1, y: [p, {q: r}]}") == {"a": {"x": "1", "y": ["p", {"q": "r"}]}}
    assert yaml.loads("title: |\n  one\n    two\n\n  three\nb: c") == {"title": "one\n  two\n\nthree\n", "b": "c"}
    assert yaml.loads("title: |-\n  one\nb: >\n  x\n  y\n\n  z\n") == {"title": "one", "b": "x y\nz\n"}
    assert yaml.loads("# head\n\na: 'it''s'\nb: \"q\\\"\\n\\u00e9\"\nc: http://x.y:80/z") == {"a": "it's", "b": 'q"\né', "c": "http://x.y:80/z"}
    assert yaml.loads("a:\n- x\n- - y\n  - z\n-\n  k: v\n  l: w\nb:\n  c:\n    d: e\n  f:") == {"a": ["x", ["y", "z"], {"k": "v", "l": "w"}], "b": {"c": {"d": "e"}, "f": None}}
    assert yaml.loads("a: [x,\n  y,  # one\n  z]\nb: 'two\n  lines'".replace("  # one", "")) == {"a": ["x", "y", "z"], "b": "two lines"}
    assert yaml.loads("a: first\n  second\nb: 2024-01-01T00:00:00Z") == {"a": "first second", "b": "2024-01-01T00:00:00Z"}
    assert yaml.loads("") == yaml.loads("# nothing\n") == {} and yaml.loads("links:\n  - target: b\n    rel: c\n  - d") == {"links": [{"target": "b", "rel": "c"}, "d"]}
    for wrong in ("a: 1\na: 2", "no field", "a: [x", "a: &anchor x", "a: *alias", "a: !tag x", "- x", "a: [x] y", "a: {x: 1, x: 2}", "a: b\n   c: d", "a: @x", "a: 'x"):
        with pytest.raises(ValueError):
            yaml.loads(wrong)


def written(r, value, indent, out):
    """value in some form of YAML."""
    blank = "  " * indent
    for k, v in value.items():
        comment = " # why: not" if r.random() < 0.2 else ""
        if isinstance(v, str):
            plain = v and v.isalnum() and r.random() < 0.5
            out.append(f"{blank}{k}: {v if plain else json.dumps(v, ensure_ascii=False)}{comment}")
        elif v is None:
            out.append(f"{blank}{k}:{comment}")
        elif isinstance(v, list) and r.random() < 0.5 and v:
            out.append(f"{blank}{k}:{comment}")
            for x in v:
                out.append(f"{blank}  - {json.dumps(x, ensure_ascii=False) if not isinstance(x, dict) else yaml._dumped(x)}")
        elif isinstance(v, dict) and v and r.random() < 0.5:
            out.append(f"{blank}{k}:{comment}")
            written(r, v, indent + 1, out)
        else:
            out.append(f"{blank}{k}: {yaml._dumped(v)}{comment}")
        if r.random() < 0.1:
            out.append(r.choice(["", "# a line", "   "]))


def test_round_trips():
    r = random.Random(1)
    text = lambda: "".join(r.choice("ab 1:#,[]{}'\"é\n-|&x") for _ in range(r.randrange(8)))

    def value(depth):
        kind = r.randrange(4 if depth else 2)
        return text() if kind == 0 else None if kind == 1 else [text() for _ in range(r.randrange(4))] if kind == 2 else {f"k{i}": value(depth - 1) for i in range(r.randrange(3))}

    for _ in range(1000):
        fields = {f"f{i}": value(2) for i in range(r.randrange(1, 6))}
        out = []
        written(r, dict(r.sample(sorted(fields.items(), key=str), len(fields))), 0, out)
        read = yaml.loads("\n".join(out))
        assert read == fields
        canonical = yaml.dumps(read, ("f3", "f1"))
        assert yaml.loads(canonical) == fields and canonical == yaml.dumps(fields, ("f3", "f1"))


def test_equal_fields_have_one_text(spark):
    docs = ["---\ntitle: A\ntags: [x, 'y, z']\nmore: {b: 1, a: 2}\n---\nbody", '---\n# c\nmore:\n  a: "2"\n  b: 1\ntags:\n- x\n- "y, z"\ntitle: |-\n  A\n---\nbody', "---\ntitle: [A\n---\nbody"]
    notes = markdown.split(spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "file string, doc string"))
    a, b, c = markdown.fields(notes).orderBy("file").collect()
    assert a.meta.canonical == b.meta.canonical == '"title": "A"\n"tags": ["x", "y, z"]\n"more": {"a": "2", "b": "1"}\n' and a.meta.tags == ["x", "y, z"]
    assert c.meta.canonical is None and c.meta.problem.startswith("no end")
