"""Licence notices as they mostly stand: wrapped over lines."""

from foliospark.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy{0}of this software and associated documentation files (the \"Software\")"
BSD = "Redistribution and use in source and binary forms, with or without{0}modification, are permitted provided that"


def test_wrapped_notices(spark):
    texts = [MIT.format("\n"), MIT.format("\r\n # "), BSD.format("\n * "), BSD.format("\n\n"), "all\nmine\nrights of\nthe many\nare\nreserved", "pad " * 30 + "\n" + BSD.format("\n"), MIT.format(" ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i in range(7)] == ["mit", "mit", "bsd", "", "", "bsd", "mit"]
    assert all(got[i][1] == 1.0 for i in (0, 1, 2, 5, 6)) and got[3][1] == got[4][1] == 0.0


def test_notices_of_a_table(spark):
    table = spark.createDataFrame([("Use it\n freely, as you wish, but at your own risk", "own"), ("Use it\n freely, as you wish, but at your own risk", "own"), ("...", "none"), (None, "x")], "text string, label string")
    notices = licenses.templates(table)
    assert [label for _, label in notices] == ["own"]
    df = spark.createDataFrame([(1, "USE IT FREELY as you wish but at your risk"), (2, "use it"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(df, notices).collect()} == {1: "own", 2: "", 3: ""}
    assert licenses.scan(df.where("false"), notices).count() == 0


def test_notices_across_signs(spark):
    gpl = "This program is free software{0} you may redistribute it and/or modify it under the terms of the GNU {1}Public License"
    real = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    texts = [gpl.format(";", "Lesser "), gpl.format(",", "Lesser "), real, real.replace(";", ".\n"), f"{real} as published. Then. {real}", "free software; the GNU. Public License; terms"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["gpl"] * 5 + [""]
    assert [round(got[i]["score"], 2) for i in range(4)] == [0.9, 0.9, 1.0, 1.0]
    assert [b["first"] for b in got[4]["blocks"] if b["label"] == "gpl" and b["share"] == 1.0] == [0, 25]
