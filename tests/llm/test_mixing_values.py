"""Mixing with more sources than were once kept apart, on the driver and as tables."""

import random

import pytest

from folioscope.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("most", [mixing.DRIVER_CELLS, 0])
@pytest.mark.parametrize("given", [True, False])
def test_every_source_has_its_own_target(spark, monkeypatch, most, given):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 100)
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choice(["en", "de"]), f"s{i % 450}", 1) for i in range(1800)]
    targets = {"source": {f"s{k}": 1 + k % 3 for k in range(450)}} if given else None
    out = mixing.mix(spark.createDataFrame(rows, DOCS), targets, budget=0.5).toPandas()
    assert len(out) == len(rows)
    mass = (out.tokens * out.weight).groupby(out.source).sum()
    mass /= mass.sum()
    sizes = out.groupby("source").tokens.sum()
    want = mass.index.map(lambda s: targets["source"][s]).to_numpy() if given else (sizes**0.7).reindex(mass.index).to_numpy()
    want = want / want.sum()
    assert mass.to_numpy() == pytest.approx(want, rel=1e-5)
    assert (out.tokens * out.probability).sum() == pytest.approx(0.5 * out.tokens.sum(), rel=1e-6)
    assert out.probability.min() > 0
