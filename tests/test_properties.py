"""Property checks of per-row functions against direct Python implementations of their rules."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewater.functions import pointer as jp
from tidewater.functions.documents import rename_root_id

keys = st.sampled_from(["a", "b", "0", "1", "a/b", "m~n", "x y", "10"])
scalars = st.one_of(st.none(), st.booleans(), st.integers(-50, 50), st.sampled_from(["s", "t", ""]))
docs = st.recursive(scalars, lambda kids: st.one_of(st.lists(kids, max_size=3),
                                                    st.dictionaries(keys, kids, max_size=3)), max_leaves=10)
tokens = st.lists(st.sampled_from(["a", "b", "0", "1", "2", "a/b", "m~n", "x y", "10", "01", "+1", "-1"]),
                  min_size=1, max_size=3)


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def resolve(doc, toks):
    """The pointer rules: object member by name, array element by integer index, else missing."""
    cur = doc
    for t in toks:
        if isinstance(cur, dict):
            if t not in cur:
                return "MISSING"
            cur = cur[t]
        elif isinstance(cur, list):
            try:
                i = int(t)
            except ValueError:
                return "MISSING"
            if not 0 <= i < len(cur):
                return "MISSING"
            cur = cur[i]
        else:
            return "MISSING"
    return cur


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(docs, tokens), min_size=1, max_size=15))
def test_pointer_matches_rules(spark, cases):
    rows, want = [], []
    for i, (doc, toks) in enumerate(cases):
        rows.append((i, json.dumps(doc)))
        want.append(resolve(doc, toks))
    df = spark.createDataFrame(rows, "i int, b string").withColumn("v", F.try_parse_json("b"))
    exprs = [F.when(F.col("i") == i, jp.extract_text(F.col("v"), jp.segments("/" + "/".join(escape(t) for t in toks))))
             for i, (_, toks) in enumerate(cases)]
    got = dict(df.select("i", F.coalesce(*exprs).alias("out")).collect())
    for i, w in enumerate(want):
        if w == "MISSING":
            assert got[i] is None, (cases[i], got[i])
        else:
            assert got[i] is not None and json.loads(got[i]) == w, (cases[i], got[i])


root_docs = st.dictionaries(st.sampled_from(["id", "push_event_id", "a", "b", "payload"]), docs, max_size=4)


@settings(max_examples=20, deadline=None)
@given(st.lists(root_docs, min_size=1, max_size=15))
def test_rename_matches_rule(spark, objs):
    texts = [json.dumps(o) for o in objs]
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    got = [r[0] for r in df.select(rename_root_id(F.col("b"), F.try_parse_json("b"))).collect()]
    for o, t, g in zip(objs, texts, got):
        if "id" in o and "push_event_id" not in o:
            want = {("push_event_id" if k == "id" else k): v for k, v in o.items()}
            assert json.loads(g) == want and list(json.loads(g)) == list(want)   # same members, same root order
        else:
            assert g == t                                                         # untouched, byte for byte
