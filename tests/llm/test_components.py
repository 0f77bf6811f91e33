from blockcodec.llm import components as C


class Links:
    """Stands for links that take so many rounds to settle."""

    def __init__(self, rounds):
        self.rounds = rounds

    def where(self, *_):
        return self

    select = distinct = agg = where

    def first(self):
        return (self.rounds,)


def test_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(C, "write_table", lambda links, name: links)
    monkeypatch.setattr(C, "_large_star", lambda links: links)
    monkeypatch.setattr(C, "_small_star", lambda links: Links(max(0, links.rounds - 1)))
    assert C.components(Links(300)).rounds == 0
