"""The command line: load raw CSVs, then one dashboard refresh to parquet."""

import os
import tempfile

from larder.__main__ import main
from test_etl import _write


def test_load_and_report(spark, capsys):
    d = tempfile.mkdtemp(prefix="larder-cli-raw-")
    _write(d, "providers", "Provider_ID,Name,Type,Address,City,Contact\n1,Acme,Restaurant,1 Main St,Springfield,555\n")
    _write(d, "receivers", "Receiver_ID,Name,Type,City,Contact\n10,Shelter,NGO,Springfield,1\n")
    _write(d, "food_listings", "Food_ID,Food_Name,Quantity,Expiry_Date,Provider_ID,Provider_Type,Location,Food_Type,Meal_Type\n"
                               "100,bread,10,2025-03-05,1,restaurant,springfield,vegetarian,breakfast\n")
    _write(d, "claims", "Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n1000,100,10,Pending,2025-03-01 10:00:00\n")
    root, out = tempfile.mkdtemp(prefix="larder-cli-root-"), tempfile.mkdtemp(prefix="larder-cli-out-")
    main(["--master", "local[2]", "load", "--csv-dir", d, "--root", root])
    main(["--master", "local[2]", "report", "--root", root, "--out", out, "--as-of", "2025-03-04"])
    panels = sorted(os.listdir(out))
    assert "overview" in panels and "next_to_expire" in panels
    assert spark.read.parquet(os.path.join(out, "next_to_expire")).count() == 1
    main(["list"])
    assert "claim_status_share" in capsys.readouterr().out
