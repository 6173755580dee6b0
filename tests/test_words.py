"""Words of rules are found in one pass over a text, and none is missed."""

from __future__ import annotations

import dataclasses
import random
import re
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sedge.functions import catalogues, clause_rules, words
from sedge.functions.rules import RuleSet
from sedge.operators import facts, risks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_those_of_plain_search(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(words, "PIECE_BYTES", 60)
    for shortest in (1, 3, 4):
        known = {"".join(rng.choice("abé\n ") for _ in range(rng.randrange(shortest, 20))) for _ in range(40)} | {"landlord)", "landlord”)", "late fee and more than sixteen"}
        marks = [(w, i) for i, w in enumerate(sorted(known))] + [("landlord)", 99)]
        texts = ["".join(rng.choice("abé\n A") for _ in range(rng.randrange(60))) for _ in range(200)]
        texts += [None, "", "the LANDLORD) and", "(“Landlord”)", "landlord", ")", "late fee and more than sixteen", "K K İ"]
        finder, n = words.Finder(marks), 0
        for raw, at in words._pieces(pa.array(texts)[1:]):
            text, place, mark = finder.places(raw, at)
            lows = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            assert lows == [(t or "").lower().encode() for t in texts[1 + n : 1 + n + len(lows)]]
            want = [(i, int(at[i]) + p, m) for i, low in enumerate(lows) for w, m in marks for p in range(len(low)) if low.startswith(w.encode(), p)]
            assert sorted(zip(text.tolist(), place.tolist(), mark.tolist(), strict=True)) == sorted(want)
            n += len(lows)
        assert n == len(texts) - 1


def test_facts_look_for_words_once_and_end_with_lines(spark):
    ends = ["\n", "\r\n", "\n\n", "\r\n\r\n", " \n", "\n \n", ""]
    said = [f"{a}Tenant: Gamma & Sons{b}{c}" for a in ("", "x\n", "Landlord: Acme Ltd\n") for b in ends for c in ("", "more", "Lessee: Delta", "\n", "\r\n", "x\ny\nTENANT: Zed ")]
    df = spark.createDataFrame([*enumerate(said), (900, None)], "doc_id int, text string")
    rules = catalogues.PARTIES
    plain = [dataclasses.replace(r, words=(), in_line=False, line_end=False) for r in rules]
    got, want = (facts.extract_facts(df, x, id="doc_id", text="text", least_chars=1) for x in (rules, plain))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
    assert "Contains(" not in plan_of(got) and plan_of(got).count("held(") == 1
    assert "held(" not in plan_of(want)


def said_by(pattern, rng):
    """A text that the pattern matches."""

    def one(op, x):
        if op is _parser.LITERAL:
            return chr(x)
        if op is _parser.NOT_LITERAL or op is _parser.ANY:
            return "q"
        if op is _parser.IN:
            kind, y = x[-1]
            return "q" if x[0][0] is _parser.NEGATE else chr(y) if kind is _parser.LITERAL else chr(y[0]) if kind is _parser.RANGE else "w"
        if op is _parser.BRANCH:
            return every(rng.choice(x[1]))
        if op is _parser.SUBPATTERN:
            return every(x[3])
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            return "".join(every(x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
        return ""

    def every(ops):
        return "".join(one(op, x) for op, x in ops)

    return every(_parser.parse(pattern))


def test_stems_are_in_every_word_of_their_list():
    rng = random.Random(1)
    for name, stems in clause_rules.STEMS.items():
        for pattern in clause_rules.WORDS[name]:
            for _ in range(60):
                text = said_by(pattern, rng)
                assert re.search(pattern, text) and any(s in text for s in stems), (name, pattern, text)


def test_risks_read_only_clauses_with_their_words(spark):
    rng = random.Random(2)
    lists, kinds, keys = list(clause_rules.WORDS.values()), ["retail", "office", "industrial", "other", None], ["Assignment", "term", "base_RENT", "insurance", "permitted_use", "opening hours", "", None]
    asked = [("unasked", "transfer"), ("barred", "transfer"), ("chance", "end"), ("begin", "open"), ("raise",), ("index",), ("subrogation",), ("narrowly", "use"), ("cotenancy",), ("percentage rent",), ("must", "centre", "hours"), ("shop", "exclusive"), ("expenses",), ("area",), ("allowance",)]
    asked += [("tenant", "answer", "earlier", "nature"), ("hazard",), ("indemnify", "landlord", "hazard"), ("tenant", "answer", "building", "access")]
    rows = []
    for i in range(4000):
        some = [rng.choice(clause_rules.WORDS[n]) for n in rng.choice(asked)] + [rng.choice(rng.choice(lists)) for _ in range(rng.randrange(3))]
        line = rng.choice((" ", " ", ". ", "\n")).join(said_by(p, rng) for p in some)
        rows.append((i, rng.choice(kinds), rng.choice(keys), rng.choice((line, line.upper(), "tenant is " + line + " by the landlord"))))
    rows.append((5000, "office", None, None))
    df = spark.createDataFrame(rows, "doc_id int, kind string, clause_key string, line string")
    text = clause_rules.clause_text(F.col("clause_key"), F.col("line"))
    rules = {kind: RuleSet(of) for kind, of in clause_rules.CLAUSE_RISKS.items()}
    base = rules.pop("all")
    assert all(r.needs for s in (base, *rules.values()) for r in s.rules)
    got = risks.all_risks(df, base, rules, kind="kind", text=text, keep=["doc_id"])
    want = risks.clause_risks(df, base, text=text, keep=["doc_id"]).unionByName(risks.typed_risks(df, rules, kind="kind", text=text, keep=["doc_id"]))
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(map(tuple, want.collect())) and len({r[1] for r in found}) > 18 and got.columns == want.columns
    assert plan_of(got).count("held(") == 1 and np.unique([r[0] for r in found]).size > 500
