"""A license is found at whatever rank its template has."""

from __future__ import annotations

from tidelog.llm import licenses


def test_lowest_rank_is_confirmed(monkeypatch):
    ranked = licenses.Scanner.ranked
    text = "Some prose about boats and harbours. It was released under the MIT License in that year."
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, t: sorted(ranked(self, t), key=lambda x: x[1] == "MIT"))
    got = licenses.Scanner()(text)
    assert [(x[2], text[x[0] : x[1]]) for x in got] == [("MIT", "released under the MIT License")]


def test_every_template_is_ranked():
    assert {n for _, n in licenses.Scanner().ranked("no word of these")} == set(licenses.templates())
