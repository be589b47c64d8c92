"""Labels of a long stream by composed functions, against the plain loop."""

import random

import pytest

from tessella.operators import legalstream, scan

FACTS = "struct<raw:boolean,num:int,lang:string,other:string,colon:boolean,bold:boolean,blank:boolean,fresh:boolean,y:int>"


def draw(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        raw = rng.random() < 0.45
        other = rng.choice([None] * 9 + ["section", "gazette", "page"])
        out.append({
            "raw": raw, "num": rng.randint(0, 4) if raw else None, "lang": rng.choice(["rw", "fe", "en", "fr"]) if raw else None, "other": other,
            "colon": rng.random() < 0.2, "bold": raw or rng.random() < 0.3, "blank": rng.random() < 0.1, "fresh": rng.random() < 0.02, "y": rng.randint(0, 5),
        })
    return out


def with_up(lines, above=None):
    for x in lines:
        x["up"] = above is not None and x["y"] <= above
        above = x["y"]
    return lines


@pytest.mark.parametrize("seed", range(8))
def test_functions_and_their_compositions_do_what_the_loop_does(seed):
    lines = with_up(draw(seed, 40))
    f, g, h = (legalstream.function_of(lines[a:b]) for a, b in ((0, 7), (7, 9), (9, 40)))
    whole = legalstream.compose(legalstream.compose(f, g), h)
    assert legalstream.compose(f, legalstream.compose(g, h)) == whole
    for kind in legalstream.KINDS:
        for lang in legalstream.LANGUAGES:
            for number in range(8):
                s = want = legalstream.State(kind, lang, number)
                for x in lines:
                    want = legalstream.follow(want, x)[0]
                assert legalstream.apply(whole, s) == want == legalstream.apply(h, legalstream.apply(g, legalstream.apply(f, s)))


@pytest.mark.parametrize("stretch,fan", [(4_096, 64), (6, 3), (1, 2)])
def test_streams(spark, monkeypatch, stretch, fan):
    monkeypatch.setattr(legalstream, "STRETCH", stretch)
    monkeypatch.setattr(scan, "FAN", fan)
    want, rows = {}, []
    for key, n in (("a", 150), (None, 40), ("c", 1)):
        lines = draw(n, n)
        rows += [(key, k, x) for k, x in enumerate(lines)]
        s = legalstream.State()
        for k, x in enumerate(lines):
            if x["other"] in ("gazette", "page"):
                want[key, k] = (x["other"], 0, None)
        for k, x in [(k, x) for k, x in enumerate(lines) if x["other"] not in ("gazette", "page")]:
            x["up"] = s.number is not None and any(want.get((key, j)) and lines[j]["other"] not in ("gazette", "page") for j in range(k)) and x["y"] <= above
            s, kind = legalstream.follow(s, x)
            above, want[key, k] = x["y"], (kind, s.number, s.lang)
    df = spark.createDataFrame(rows, f"key string, at int, facts {FACTS}")
    got = {(r["key"], r["at"]): (r["class"], r["number"], r["lang"]) for r in legalstream.label_stream(df, ["key"], ["at"]).collect()}
    assert got == want


def test_empty_stream(spark):
    assert legalstream.label_stream(spark.createDataFrame([], f"key string, at int, facts {FACTS}"), ["key"], ["at"]).collect() == []
