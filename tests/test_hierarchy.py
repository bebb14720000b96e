"""A tree of categories into four tables, against nested loops."""

from __future__ import annotations

import json

from docloom.operators import hierarchy

TREE = {
    "categories": [
        {"name": "PETITION", "summary": "Writ", "description": None, "code": "P", "caseTypes": [
            {"name": "Writ", "code": "W", "defective": True, "subCategories": ["a", "b"], "fileWith": ["Order", "Deed, If Any", "Receipt if available"]}, {"name": "Review", "code": "R", "fileWith": ["Order if relevant"]},
        ]},
        {"name": "EMPTY", "code": "E"},
        {"name": "APPEAL", "caseTypes": [{"name": "First", "subCategories": ["c", None]}, {"name": None, "subCategories": [], "fileWith": ["x"]}]},
    ]
}


def nested(key, tree):
    out = {"categories": [], "case_types": [], "sub_categories": [], "requirements": []}
    for c in tree.get("categories", []):
        n = len(out["categories"]) + 1
        out["categories"].append((key, n, "high", c.get("name"), c.get("summary"), c.get("description"), c.get("code"), n))
        for t in c.get("caseTypes", []):
            m = len(out["case_types"]) + 1
            out["case_types"].append((key, m, n, t.get("name"), t.get("code"), t.get("defective", False), m))
            for s in t.get("subCategories", []):
                out["sub_categories"].append((key, m, s, len(out["sub_categories"]) + 1))
            for d in t.get("fileWith", []):
                kind = "optional" if any(o in d.lower() for o in hierarchy.OPTIONAL) else "required"
                out["requirements"].append((key, m, d, kind, len(out["requirements"]) + 1))
    return out


def test_four_tables(spark):
    trees = [(1, json.dumps(TREE)), (2, "{}"), (3, None), (4, "no json"), (5, json.dumps({"categories": []})), (6, json.dumps({"categories": [TREE["categories"][2]]}))]
    got = hierarchy.normalised(spark.createDataFrame(trees, "k int, j string"), "k", "j")
    want = [nested(k, json.loads(j)) for k, j in trees if k in (1, 6)]
    for name, df in got.items():
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((r for w in want for r in w[name]), key=repr)
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in got.values())
