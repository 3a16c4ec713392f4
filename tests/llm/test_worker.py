from tessera.llm import worker


def test_a_new_owner_drops_the_memo_of_the_last(monkeypatch):
    monkeypatch.setattr(worker, "_owner", ["", None])
    one, two = {1: 1}, {2: 2}
    worker.claim("one", one.clear)
    worker.claim("one", one.clear)
    assert one
    worker.claim("two", two.clear)
    assert not one and two
