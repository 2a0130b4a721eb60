"""A benchmark in several automata gives what one automaton gives."""

import random

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from larder.llm import decontamination


def test_parts_are_united(spark, odd_docs, no_docs):  # noqa: F811
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["日本", "Ünï"]
    items = [(i % 25, " ".join(rng.choices(words, k=rng.randint(0, 22)))) for i in range(40)] + [(None, "word30 of the tale"), (50, None), (51, "short text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(rng.choices(words, k=20)) + ". " + (items[i][1] or "").upper() + "! " + (items[(i * 7) % 40][1] or "") for i in range(40)]
    docs = odd_docs.select("doc_id", "text", "n_words").union(
        spark.createDataFrame([(100 + i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    )

    def rows(**options):
        judged, at = decontamination.decontaminate(spark, docs, bench, **options)
        assert judged.columns[:3] == ["doc_id", "text", "n_words"]
        return sorted(map(repr, judged.collect()))

    one = rows()
    assert sum("contaminated=True" in r for r in one) > 20
    for automaton in (300, 40, 1):
        assert rows(automaton=automaton) == one
    assert decontamination.decontaminate(spark, no_docs, bench, automaton=5)[0].count() == 0


def test_ranges_are_united():
    assert decontamination.united([(5, 7), (1, 3), (2, 4), (7, 9), (20, 21)]) == [[1, 4], [5, 9], [20, 21]]
    assert decontamination.united([]) == []
