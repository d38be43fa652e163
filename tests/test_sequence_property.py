"""Random inputs: the chunked sequence scan equals a per-user loop."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clickcast.operators.sequence import sequence_features

BASE = dt.datetime(2024, 1, 1)


def brute(rows):
    """rows: (click_id, ip, device, os, seconds | None, label | None)."""
    out = {}
    users = {}
    for r in rows:
        users.setdefault((r[1], r[2], r[3]), []).append(r)
    for clicks in users.values():
        clicks.sort(key=lambda r: (r[4] is not None, r[4] or 0, r[0]))
        ta, start_idx, start_t, prev = 0, 0, None, None
        for i, (cid, _, _, _, sec, lab) in enumerate(clicks):
            if i == 0:
                start_t = sec
            elif prev == 1:  # the previous click converted: a new attempt starts here
                ta, start_idx, start_t = ta + 1, i, sec
            diff = None if sec is None or start_t is None else abs(int(sec) - int(start_t)) / 60
            out[cid] = (prev, ta, i - start_idx, diff)
            prev = lab
    return out


row = st.tuples(
    st.integers(0, 2),                                   # ip
    st.integers(0, 1),                                   # device
    st.one_of(st.none(), st.integers(0, 4000).map(lambda s: s * 7.5)),  # seconds (ties, nulls)
    st.one_of(st.integers(0, 1), st.none()),             # label
)


@settings(max_examples=25, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(row, min_size=1, max_size=60), st.sampled_from([1, 60, 900, 7200, 10 ** 7]),
       st.sampled_from([2, 5, 1_000_000]))
def test_chunked_scan_equals_loop(spark, rows, chunk, target):
    data = [(i, ip, dev, 0, None if s is None else BASE + dt.timedelta(seconds=s), lab)
            for i, (ip, dev, s, lab) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "click_id long, ip int, device int, os int, click_time timestamp, is_attributed int")
    got = {r.click_id: (r.prev_label, r.times_attributed, r.n_previous_clicks, r.click_time_diff)
           for r in sequence_features(df, chunk_seconds=chunk, target_chunk_rows=target).collect()}
    secs = [(i, ip, dev, 0, None if s is None else (BASE + dt.timedelta(seconds=s)).timestamp()
             - BASE.timestamp() + 1704067200, lab) for i, (ip, dev, s, lab) in enumerate(rows)]
    want = brute(secs)
    assert got == want
