"""Licence scan, chat windows and URL filter: column functions only."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from verispark.llm import chat, licences, url_filter
from verispark.llm.queries import QUERIES, URL_RULES

MIT = licences.LICENCES["MIT"][0]


def scan(rows, *texts, **kw):
    got = licences.scan_licences(rows("doc_id long, text string", *enumerate(texts), **kw)).collect()
    return sorted((r.doc_id, r.licence, r.n_matches) for r in got)


def test_licences(rows):
    wrapped = "Intro.\n\n" + MIT.replace(", ", ",\n") + "\n\nEnd."
    turned = ". ".join(reversed(MIT.split(": ")))
    got = scan(
        rows, "x. Released under the MIT License.\ny", wrapped, turned, None, "", "no licence here. MIT License",
        "a line\nLicensed under CC BY-NC 4.0.\nb\nlicensed under cc by-nc 4.0", MIT + " " + MIT, "z. " * 50_000 + "SPDX-License-Identifier: ISC", extra=True)
    assert got == [(0, "MIT", 1), (1, "MIT", 1), (6, "CC-BY-NC-4.0", 2), (7, "MIT", 2), (8, "ISC", 1)]
    # The tag's colon is a sentence end, so its two halves are ordered identifiers too.
    assert scan(rows, "SPDX-License-Identifier: ISC") == [(0, "ISC", 1)]
    assert scan(rows) == []


def test_order_matters(rows):
    first, second = "SPDX-License-Identifier:", "MIT"
    assert scan(rows, f"{first} {second}") == [(0, "MIT", 1)]
    assert scan(rows, f"{second}. {first}") == []


def test_common_licences(rows):
    bsd2 = licences.LICENCES["BSD-2-Clause"][0].replace("Redistributions", "\n* Redistributions")
    third = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd3 = [f"{bsd2}\n3. {third.format(x)}\n" for x in ("the copyright holder", "Some Firm Inc.")]
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    assert scan(rows, *bsd3, f"{bsd2}\n\n{bsd3[0]}", f"{bsd3[1]}\n\n{bsd2}", bsd2 + "\n" + bsd2) == [
        (0, "BSD-3-Clause", 1), (1, "BSD-3-Clause", 1), (2, "BSD-2-Clause", 1), (2, "BSD-3-Clause", 1), (3, "BSD-2-Clause", 1), (3, "BSD-3-Clause", 1), (4, "BSD-2-Clause", 2)]
    texts = {
        "Licensed under the GNU GPL v3": "GPL-3.0", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", lgpl: "LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL-3.0",
        lgpl.replace("library", "program").replace("Lesser", "Affero").replace("2.1", "3"): "AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
        "This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy": "MPL-2.0", "SPDX-License-Identifier: CC0-1.0": "CC0-1.0",
        "This project is licensed under the BSD 3-Clause License.": "BSD-3-Clause", "/* SPDX-License-Identifier: EPL-2.0 */": "EPL-2.0", "Released under the EPL 1.0": "EPL-1.0"}
    assert scan(rows, *texts) == [(i, x, 1) for i, x in enumerate(texts.values())]


CHAT = "conv_id long, turn long, role string, text string"


def digests(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (40, 12), (16, 0)])
def test_chat_round_trip(spark, rows, budget, history):
    nasty = [r"\### Assistant: </turn> ok", "<turn><turn-text></turn>\n", "\\<\\turn\\\\", "", "é🙂\u0301", "<", "\\", "a " * 300]
    talks = {
        1: [("system", "be kind </turn>"), *[("user" if k % 2 else "assistant", f"{t} {k}") for k, t in enumerate(nasty)]],
        2: [("user", "hi"), ("assistant", "yes"), ("system", "late"), ("assistant", "no")],
        3: [(r"a<turn\n", "x"), ("assistant", "")],
    }
    table = rows(CHAT, *[(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)], extra=True)
    windows = chat.format_chats(table, budget, history)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digest(windows).collect()}
    assert got == {c: digests(t) for c, t in talks.items()}
    if budget < 100:
        some = windows.filter("conv_id = 1").orderBy("window").collect()
        assert len(some) > 3 and all(w.text.startswith("<turn>system<turn-text>be kind <\\/turn>") for w in some)
        assert any(w.n_repeated > 1 for w in some) == (history > 0)
        for w in some:
            assert all(w.text[s.start - len("<turn-text>") : s.start] == "<turn-text>" and w.text[s.end : s.end + 7] == "</turn>" for s in w.loss_spans)


def test_chat_windows_keep_the_budget(spark, rows):
    table = rows(CHAT, (0, 0, "system", "s s s"), *[(0, k, "user" if k % 2 else "assistant", "w " * (k % 7)) for k in range(1, 900)])
    windows = chat.format_chats(table, 60, 20).select("n_turns", (chat.word_tokens(F.regexp_replace("text", "<turn>|<turn-text>|</turn>", "")) - F.regexp_count("text", F.lit("<turn-text>")) + 4 * F.regexp_count("text", F.lit("<turn-text>"))).alias("size")).collect()
    assert sum(w.n_turns for w in windows) == 900 and max(w["size"] for w in windows) <= 60


def test_chat_defined_results(rows):
    table = rows(CHAT, (None, 0, "user", "a"), (None, None, None, None), (5, 1, "assistant", "t"), (5, 1, "assistant", "t"), (6, 0, "assistant", None))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_digest(chat.format_chats(table)).collect()}
    assert got == {None: (2, 0), 5: (2, 2), 6: (1, 0)}
    assert chat.format_chats(rows(CHAT)).count() == 0


def judge(rows, urls, listed=(), **kw):
    table = rows("page_id long, url string", *enumerate(urls), extra=True)
    got = url_filter.filter_urls(table, rows("url string", *[(u,) for u in listed]), URL_RULES, **kw).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}


def test_url_rules(rows):
    urls = [None, "", "no scheme", "https://A.Example.NET/en/x?q#f", "http://example.net/de/", "x://b.example.com/de/1", "x://example.com/De/1", "ftp://q.org/fr/", "http://notexample.net",
            "http://net/", "http://a.net:80/", "http://x.org?y://z/fr/", "://net/", "http://évé.ÉA/p"]
    got = judge(rows, urls)
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        4: ("example.net", "/de/", "net/", "block"), 5: ("b.example.com", "/de/1", "example.com/de/", "block"), 6: ("example.com", "/De/1", None, "allow"),
        7: ("q.org", "/fr/", "org/fr/", "allow"), 8: ("notexample.net", "", None, "allow"), 9: ("net", "/", "net/", "block"), 10: ("a.net:80", "/", None, "allow"),
        11: ("x.org", "", None, "allow"), 12: ("net", "/", "net/", "block"), 13: ("évé.Éa", "/p", None, "allow")}
    assert judge(rows, []) == {}


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_url_list(rows, broadcast_bytes):
    listed = ["http://www.bad.de/page.html", None, "no", *[f"http://l{i}.de/" for i in range(500)]]
    asked = ["https://bad.de/page/", "https://m.bad.de/page?utm_source=x&ref=1", "https://bad.de/page?a=1", "http://l7.de", "http://l7.de", *[f"http://o{i}.de/" for i in range(500)]]
    got = judge(rows, asked, listed, broadcast_bytes=broadcast_bytes)
    assert {i for i, r in got.items() if r[3] == "block"} == {0, 1, 3, 4} and len(got) == len(asked)


def test_native_queries_run_no_python(spark, sf):
    for name in ("op3_licence_scan", "op4_chat_windows", "op5_url_filter"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name
