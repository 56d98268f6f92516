import json
import random

from clausemill.operators import extraction


def responses(seed):
    draw = random.Random(seed)
    odd = [None, "five", 3, 3.5, -1, 2.0, 10**12, True, [], ["a"], ["a", None], {}, {"value": 1}]

    def leaf(want):
        if draw.random() < 0.06:
            return draw.choice(odd)
        if isinstance(want, tuple):
            return draw.choice(want)
        if want.endswith("?") and draw.random() < 0.3:
            return None
        return {"string": "text", "number": draw.choice([5, 2.5, 1e300]), "int": 7, "confidence": draw.choice([0, 1, 0.25]), "strings": draw.choice([[], ["a", "b"]]), "bool": True}[want.rstrip("?")]

    def member(spec):
        if isinstance(spec, list):
            return [member(spec[0]) for _ in range(draw.randrange(3))]
        out = {n: leaf(w) for n, w in spec.items() if draw.random() > 0.02}
        return out | ({"more": 1} if draw.random() < 0.05 else {})

    out = []
    for spec in (extraction.LOAN, extraction.CONTRACT):
        rows = [json.dumps({n: member(s) if draw.random() > 0.03 else draw.choice(odd) for n, s in spec.items()}) for _ in range(150)]
        out.append((spec, rows + ["", "no json", "[]", "null", "{}", None]))
    return out


def test_both_paths_agree(spark, monkeypatch):
    """What one look at the schema lets through is what the rules let through, with the same values."""
    for spec, rows in responses(3):
        frame = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "id int, raw string")
        quick = extraction.parse_output(frame, spec)
        with monkeypatch.context() as patch:
            patch.setattr(extraction, "_quick", lambda name, s: f"CAST(NULL AS {'array<' + extraction.J.struct_type(s[0]) + '>' if isinstance(s, list) else extraction.J.struct_type(s)})")
            slow = extraction.parse_output(frame, spec)
        got, expected = ({r["id"]: r for r in x.collect()} for x in (quick, slow))
        assert got == expected and any(r["valid"] for r in got.values()) and not all(r["valid"] for r in got.values())
