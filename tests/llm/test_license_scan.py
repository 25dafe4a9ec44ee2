import re

import pytest

from tracelode.llm import license_scan as L


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"The river {i} ran on\nand the town slept by the old mill, of which nobody spoke.\nLine {i} of the tale") for i in range(200)], "doc_id long, text string")
    return L.fit(docs, 400)


def test_every_template_has_a_cue():
    assert all(re.search(L.CUES, t) for ts in L.TEMPLATES.values() for t in ts)


def test_templates_are_found_and_other_sentences_are_not(spark, model):
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in L.TEMPLATES.items() for t in ts)]
    rows += [(1000 + i, t, "") for i, t in enumerate(L.OTHERS)] + [(2000, None, ""), (2001, "", ""), (2002, "No paragraph with a cue.", "")]
    df = spark.createDataFrame([(i, f"Some prose.\n{t}\nMore prose." if t else t, 1) for i, t, _ in rows], "doc_id long, text string, families int")
    out = {r["doc_id"]: r for r in L.scan(df, model).collect()}
    assert sum(f in out[i]["families"] for i, _, f in rows if f) >= 0.9 * sum(bool(f) for _, _, f in rows)
    assert not any(out[i]["families"] for i, _, f in rows if not f)
    assert [x["place"] for x in out[0]["licences"]] == [1] and out[0]["n_paragraphs"] == 3 and out[2000]["n_paragraphs"] == 0


def test_repeated_rows_and_no_rows(spark, model):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_candidates"], r["families"]) for r in L.scan(df, model).collect()), key=str)
    assert out == [(1, 1, ["MIT"]), (1, 1, ["MIT"]), (None, 1, ["CC-BY-NC"])]
    assert L.scan(df.limit(0), model).collect() == []


def test_a_licence_without_a_cue_is_found(spark, model):
    real = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    assert not re.search(L.CUES, real)
    df = spark.createDataFrame([(1, f"Some prose.\n{real}"), (2, "One of the boats is in the bay, and any person is free to use it.")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in L.scan(df, model).collect()}
    assert out[1]["families"] == ["Unlicense"] and out[1]["licences"][0]["place"] == 1 and not out[2]["families"]


#: Notices as projects write them, worded otherwise than the templates, and sentences that are none.
HELD_OUT = [
    ("This software is released under the terms of the MIT License, see LICENSE.", "MIT"),
    ("The project is available under the MIT license.", "MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this font and associated documentation, to deal in the Software without restriction, including the rights to use, copy and modify it.", "MIT"),
    ("Distributed under the Apache License, Version 2.0 (see LICENSE).", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0; you may not use these files except in compliance with the License.", "Apache-2.0"),
    ("You may obtain a copy of the License at the address http://www.apache.org/licenses/LICENSE-2.0 or from the author", "Apache-2.0"),
    ("You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "GPL-3.0"),
    ("This file is licensed under the GNU General Public License, version 3 or later.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2 only.", "GPL-2.0"),
    ("The library is licensed under the GNU Lesser General Public License.", "LGPL"),
    ("The server is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Use of the source code is governed by a BSD-style license that can be found in the file LICENSE.", "BSD"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met:", "BSD"),
    ("Permission to use, copy, modify, and/or distribute this code for any purpose with or without fee is hereby granted.", "ISC"),
    ("This file is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("The text is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY"),
    ("Its images are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"),
    ("The data are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC"),
    ("To the extent possible under law, the editors have waived all copyright and related rights to this table under CC0.", "CC0"),
    ("This is free and unencumbered software released into the public domain by its maker.", "Unlicense"),
    ("A license from the city is needed to sell fish at the harbour.", ""),
    ("The software was written in two weeks and nobody was asked for permission.", ""),
    ("She signed the contract under the terms of the bank, version 2 of which was lost.", ""),
    ("The public library keeps a general copy of every version of the paper.", ""),
    ("The work was published by the foundation without warranty of success.", ""),
    ("Provided that the following is true, the river rises in spring.", ""),
    ("You can obtain a copy of the key from the porter at the gate.", ""),
    ("Use of the kitchen is governed by a list that can be found on the door.", ""),
    ("The court waived all claims to the extent possible under the law.", ""),
    ("It is released to the press under the name of the author.", ""),
]


def test_held_out_notices(spark, model):
    df = spark.createDataFrame([(i, f"Some prose.\n{t}") for i, (t, _) in enumerate(HELD_OUT)], "doc_id long, text string")
    out = {r["doc_id"]: r["families"] for r in L.scan(df, model).collect()}
    right = sum(out[i] == [f] for i, (_, f) in enumerate(HELD_OUT) if f)
    wrong = [(t, out[i]) for i, (t, f) in enumerate(HELD_OUT) if out[i] and out[i] != [f]]
    print("found", right, "of", sum(bool(f) for _, f in HELD_OUT), "wrong", wrong, "missed", [t for i, (t, f) in enumerate(HELD_OUT) if f and not out[i]])
    assert right >= 16 and not wrong


def test_long_texts_and_clashing_columns(spark, model):
    text = "\n".join(["A line of plain prose about the weather and the sea."] * 5000 + ["Released under the MIT License."])
    df = spark.createDataFrame([(1, text, "kept", 2.0)], "doc_id long, text string, probability string, agreement double")
    r = L.scan(df, model).collect()[0]
    assert r["n_paragraphs"] == 5001 and r["licences"][0]["place"] == 5000 and r["probability"] == "kept" and r["agreement"] == 2.0
