from builders import sample
from larder.operators import integrity as IN
from larder.schemas import FOREIGN_KEYS


def test_pk_and_fk(spark):
    t = sample(spark)
    dup = t["providers"].unionByName(t["providers"].where("Provider_ID = 1"))
    bad = dict(t, providers=dup)
    assert [tuple(r) for r in IN.pk_violations(bad).collect()] == [("providers", 1, 2)]
    no_acme = t["providers"].where("Provider_ID <> 1")
    v = IN.fk_violations(dict(t, providers=no_acme)).collect()
    assert [tuple(r) for r in v] == [("food_listings", "Provider_ID", 1, 2)]
    orphans = IN.fk_orphans(t["food_listings"], no_acme, FOREIGN_KEYS[0])
    assert {r.Food_ID for r in orphans.collect()} == {100, 101}


def test_lengths(spark):
    t = sample(spark)
    long_name = t["providers"].selectExpr("Provider_ID", "repeat('x', 300) AS Name", "Type", "Address", "City", "Contact")
    got = [tuple(r) for r in IN.length_violations({"providers": long_name}).collect()]
    assert ("providers", "Name", 1, 300, 255) in got and len(got) == 3
