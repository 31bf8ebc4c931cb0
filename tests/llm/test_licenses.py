"""Customary licence texts, wrapped as they are found."""

from corpusloom.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%sRedistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%sRedistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
APACHE = """Copyright 2020 Some One
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def test_customary_texts(spark):
    cases = [(MIT, "mit-full"), (BSD % ("1. ", "2. "), "bsd-full"), (BSD % ("* ", "* "), "bsd-full"), (APACHE, "apache-full"), (GPL, "gpl-grant")]
    cases += [(commented(t, mark), rule) for t, rule in cases for mark in ("#", " *", "//")]
    cases += [(t.replace("\n", "\r\n"), rule) for t, rule in cases[:5]] + [(" ".join(t.split()), rule) for t, rule in cases[:3] + cases[4:5]]
    cases += [("x y\nAll rights reserved\nand more", "reserved"), ("Released under the MIT License\nAll rights\nreserved", "reserved-over-mit"), ("all rights\n\nreserved", None)]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.rule for r in license_scan.scan_licenses(rows).collect()}
    assert [got[k] for k in range(len(cases))] == [rule for _, rule in cases]


def test_notices_by_rule(spark):
    texts = ["Licensed under either the MIT License.\nThis project is licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
             "Distributed under the Mozilla Public License, version 2.0.", "This text is licensed under CC BY-NC-SA 4.0.", "distributed under cc by 4.0", "accept under bylaws"]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "`doc_id` long, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.verdict) for r in out] == [("MIT OR Apache-2.0", "permissive"), ("CC-BY-SA-4.0", "copyleft"), ("MPL-2.0", "copyleft"), ("CC-BY-NC-SA-4.0", "noncommercial"), ("CC-BY-4.0", "permissive"), (None, "none")]


def test_every_lead_with_every_name(spark):
    cases = [(lead, name, lic, verdict) for _, lic, verdict, names in license_scan.NAMED for name in names for lead in license_scan.LEADS]
    texts = [f"Some words here.\n{lead.capitalize()} {name.upper()}\nand others." for lead, name, _, _ in cases]
    texts += [t.replace("CC BY", "CC-BY-").replace(" 4 0", " 4.0") for t, c in zip(texts, cases) if c[1] == "cc by 4 0"]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = [(lic, verdict) for _, _, lic, verdict in cases] + [("CC-BY-4.0", "permissive")] * len(license_scan.LEADS)
    assert [(r.license, r.verdict) for r in out] == want
