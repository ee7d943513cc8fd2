"""A job's timers and state follow its batches, not its events times its timers."""

import numpy as np

from chartloom.streaming.job_timers import RunTimer


class Handle:
    """List state and timers of one key, without Spark."""

    def __init__(self):
        self.timers, self.items, self.read = [], [], 0

    def getListState(self, name, schema):
        return self

    getMapState = None  # a map of single events costs a call for each of them

    def registerTimer(self, at):
        self.timers.append(at)

    def appendValue(self, value):
        self.items.append(value)

    def put(self, values):
        self.items = list(values)

    def clear(self):
        self.items = []

    def get(self):
        self.read += len(self.items)
        return iter(self.items)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.timers[-1]


class Event:
    def __init__(self, at, event_id, event):
        self.at, self.event_id, self.event = at, event_id, event


def test_one_timer_and_one_read_a_batch():
    handle, timer = Handle(), RunTimer(100)
    timer.init(handle)
    events = [Event(i * 10, i, "start") for i in range(5000)] + [Event(-500, None, "start"), Event(49_990, 7777, "fail"), Event(90_000, 9, "start")]
    list(timer.handleInputRows((1,), iter(events), handle))
    assert handle.timers == [-400] and len(handle.items) == 1
    handle.now = 60_000
    rows = list(timer.handleExpiredTimer((1,), handle, handle))
    # every start is followed by the next one, but for the one before 1970 and the last one
    assert [(r.event_id, r.started_ms) for r in rows] == [(None, -500), (4999, 49_990)]
    assert handle.read == 1 and handle.timers == [-400, 90_100]
    assert len(np.frombuffer(handle.items[0][0], np.int64)) == 4
    handle.now = 90_100
    assert [r.event_id for r in timer.handleExpiredTimer((1,), handle, handle)] == [9] and handle.items == []
