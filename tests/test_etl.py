"""CSV -> clean -> audit -> versioned load, with quarantine."""

import os
import tempfile

from larder.plans.etl import RAW_FILES, load_from_csv
from larder.sources.tables import read_tables


def _write(d, name, text):
    with open(os.path.join(d, RAW_FILES[name]), "w") as fh:
        fh.write(text)


def test_load_from_csv(spark):
    d = tempfile.mkdtemp(prefix="larder-raw-")
    _write(d, "providers", 'Provider_ID,Name,Type,Address,City,Contact\n'
                           '1,"Acme, Inc",Restaurant,"1 Main\nSt",Springfield,555-1\n'
                           '2,Bobs,Grocery,,Capital,NA\n'
                           '2,Bobs Dup,Grocery,,Capital,\n')
    _write(d, "receivers", 'Receiver_ID,Name,Type,City,Contact\n10,Shelter,NGO,Springfield,(555) 2\n')
    _write(d, "food_listings", 'Food_ID,Food_Name,Quantity,Expiry_Date,Provider_ID,Provider_Type,Location,Food_Type,Meal_Type\n'
                               '100,bread,10,3/5/2025,1,restaurant,springfield,vegetarian,breakfast\n'
                               '101,soup,0,3/5/2025,1,restaurant,springfield,vegan,lunch\n'
                               '102,rice,5,3/6/2025,7,grocery,nowhere,vegan,dinner\n'
                               '103,milk,2,3/7/2025,2,grocery,capital,dairy,breakfast\n')
    _write(d, "claims", 'Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n'
                        '1000,100,10,pending ,3/1/2025 10:00\n'
                        '1001,102,10,Completed,3/2/2025 10:00\n'
                        '1002,103,10,completed,3/3/2025 11:30\n'
                        '1003,100,99,Pending,3/4/2025 09:15\n')
    root = tempfile.mkdtemp(prefix="larder-load-")
    load_from_csv(spark, d, root)
    t = read_tables(spark, root)
    assert sorted(r.Provider_ID for r in t["providers"].collect()) == [1]  # id 2 repeated -> quarantined
    prov = t["providers"].collect()[0]
    assert (prov.Name, prov.Address, prov.Contact) == ("Acme Inc", "1 Main St", "5551")
    # 101 dropped by cleaning (quantity 0); 102 has no provider 7; 103's provider 2 was quarantined
    assert sorted(r.Food_ID for r in t["food_listings"].collect()) == [100]
    assert t["food_listings"].collect()[0].Food_Name == "Bread"
    claims = {r.Claim_ID: r.Status for r in t["claims"].collect()}
    assert claims == {1000: "Pending"}  # 1001/1002 reference quarantined listings, 1003 a missing receiver
    q = spark.read.parquet(os.path.join(root, "_quarantine", "claims"))
    assert q.count() == 3
    q2 = spark.read.parquet(os.path.join(root, "_quarantine", "providers"))
    assert q2.count() == 2 and q2.select("reason").distinct().count() == 1
