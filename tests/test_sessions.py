"""Sessions from a stream against a plain replay, in several batchings."""

import random

import pytest

from corpusloom.operators import snapshots
from corpusloom.streaming import sessions


def plain(events):
    """owner -> session -> [title, seq, [(role, text, seq)]]."""
    out = {}
    for o, seq, s, kind, role, text, other in sorted(events, key=lambda e: e[:2]):
        own = out.setdefault(o, {})
        if kind == "new" and s not in own:
            own[s] = [text, seq, []]
        elif kind == "append" and s in own:
            own[s][2].append((role, text, seq))
        elif kind == "title" and s in own:
            own[s][:2] = [text, seq]
        elif kind in ("remove", "clear"):
            gone = [x for x in own if kind == "clear" or x == s]
            for x in gone:
                del own[x]
            if gone and not own and other is not None:
                own[other] = [None, seq, []]
    return sorted(((o, s, n, *row) for o, ss in out.items() for s, (title, seq, ms) in ss.items() for n, row in enumerate([(None, title, seq), *ms])), key=repr)


def made(rnd, n):
    kinds = ["new"] * 2 + ["append"] * 8 + ["title", "remove", "clear"]
    events = []
    for k in range(n):
        kind = rnd.choice(kinds)
        events.append((f"o{rnd.randint(0, 4)}", k, f"s{rnd.randint(0, 3)}", kind, rnd.choice(["user", None]), rnd.choice(["hello", None, f"m{k}"]), f"r{k}" if rnd.random() < 0.5 else None))
    return events


@pytest.mark.parametrize("cuts", [(), (40, 41, 90)])
def test_any_batching_gives_the_plain_table(spark, tmp_path, cuts):
    rnd = random.Random(8)
    events = made(rnd, 120)
    bounds = [0, *cuts, len(events)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = events[max(0, a - 3 * bool(k)) : b]  # some events are sent again
        rnd.shuffle(part)
        spark.createDataFrame(part, sessions.EVENT).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(sessions.EVENT).json(f"{tmp_path}/in")
        sessions.session_stream(stream, f"{tmp_path}/t", f"{tmp_path}/c", 4).awaitTermination()  # goes on from the checkpoint
    assert sorted(map(tuple, snapshots.load(spark, f"{tmp_path}/t").collect()), key=repr) == plain(events)
    told = {(r.owner, r.session): r.messages for r in sessions.sessions(spark, f"{tmp_path}/t").collect()}
    assert sum(told.values()) == sessions.messages(spark, f"{tmp_path}/t").count() and len(told) == sum(r[2] == 0 for r in plain(events))


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([(None, 1, "s", "new", None, None, None)], sessions.EVENT).write.json(f"{tmp_path}/in")
    sessions.session_stream(spark.readStream.schema(sessions.EVENT).json(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert sessions.sessions(spark, f"{tmp_path}/t").count() == 0


class _State:
    """A state variable that counts what it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def _called(self, *given):
        self.calls += 1
        return given

    def exists(self):
        return self._called() == () and self.value is not None

    def get(self):
        return self._called() or self.value

    def update(self, value):
        self.value = self._called(value)[0]

    def iterator(self):
        return iter(self._called())

    updateValue = removeKey = _called


def test_an_owner_is_read_once_and_written_once():
    import pandas as pd

    made = []
    handle = type("Handle", (), {k: lambda *_: made.append(_State()) or made[-1] for k in ("getValueState", "getMapState")})()
    owner = sessions.Sessions()
    owner.init(handle)
    events = pd.DataFrame([(k, f"s{k % 30}", "new" if k < 30 else "append", "user", f"text {k}", None) for k in range(90)], columns=["seq", "session", "kind", "role", "text", "replacement"])
    assert len(pd.concat(owner.handleInputRows(("o",), iter([events[60:], events[:60]]), None))) == 90
    assert sum(s.calls for s in made) == 2
    assert not list(owner.handleInputRows(("o",), iter([events]), None)) and sum(s.calls for s in made) == 3
