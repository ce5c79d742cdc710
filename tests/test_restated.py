"""Queries that both engines read from one text, against plain Python over the same rows."""

import statistics as st
from collections import Counter, defaultdict
from datetime import date

import pytest

from weftline.operators.runs import sites_named
from weftline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").collect()
    return sorted(rows, key=lambda r: (r.ts, r.event_id))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture
def rows(spark):
    def of(name):
        return [tuple(r) for r in QUERIES[name](spark, SF).collect()]

    return of


def grouped(events, key):
    out = defaultdict(list)
    for e in events:
        out[key(e)].append(e)
    return out


def day(e):
    return str(e.ts.date())


def good(e):
    return e.event_type != "error"


def test_runs(rows, events):
    by = grouped(events, day)
    assert rows("latest_run") == [(max(by), len(by[max(by)]))]
    assert sorted(rows("last_two_runs"), key=lambda r: r[1]) == [(d, i + 1) for i, d in enumerate(sorted(by, reverse=True)[:2])]
    labels = {r[0]: r[1:] for r in rows("run_change_labels")}
    days = sorted(by)
    mean = lambda x: st.fmean(e.value for e in x if good(e))
    rate = lambda x: st.fmean(e.event_id % 101 for e in x if good(e))
    word = lambda now, last, less, more: less if now < last else more if now > last else "SAME"
    assert labels[days[0]] == (0.0, "SAME", "SAME")
    for last, now in zip(days, days[1:]):
        change, label, success = labels[now]
        assert change == pytest.approx((mean(by[now]) - mean(by[last])) / mean(by[last]) * 100, abs=1e-3)
        assert label == word(mean(by[now]), mean(by[last]), "FASTER", "SLOWER") and success == word(rate(by[now]), rate(by[last]), "WORSE", "BETTER")


def test_summaries(rows, events):
    ((total, ok, failed, rate, whole, mean, least, most),) = rows("summary_stats")
    fine = [e.value for e in events if good(e)]
    assert (total, ok, failed) == (len(events), len(fine), len(events) - len(fine))
    assert (rate, whole, mean, least, most) == pytest.approx((100 * len(fine) / len(events), sum(fine), st.fmean(fine), min(fine), max(fine)), abs=1e-2)
    by = grouped((e for e in events if good(e)), lambda e: "unknown" if e.event_id % 11 == 0 else e.event_type)
    found = {r[0]: r[1:] for r in rows("stats_by_category")}
    assert {k: v[0] for k, v in found.items()} == {k: len(x) for k, x in by.items()}
    assert all(found[k][1] == pytest.approx(st.fmean(e.value for e in x), abs=1e-3) for k, x in by.items())
    assert {(r[0], r[1]) for r in rows("batch_summary")} == set(Counter(map(good, events)).items())
    sites = {u: round(100 * sum(map(good, x)) / len(x), 4) for u, x in grouped(events, lambda e: e.user_id).items()}
    best, worst = min(sites, key=lambda u: (-sites[u], u)), min(sites, key=lambda u: (sites[u], u))
    assert sorted(rows("best_worst")) == sorted([(best, sites[best], True), (worst, sites[worst], False)])


def test_jobs(rows, events):
    by = grouped(events, lambda e: e.user_id)
    last = {u: x[-1].event_type for u, x in by.items()}
    state = {"purchase": "completed", "error": "error", "signup": "cancelled"}
    assert dict(rows("job_status")) == {u: state.get(t, "cloning") for u, t in last.items()}
    shares = (0, 10, 15, 20, 22, 25, 30, 70, 75, 90, 100)
    known = {u: [shares[e.event_id % 12] for e in x if e.event_id % 12 < 11] for u, x in by.items()}
    assert dict(rows("progress_latest")) == {u: (x[-1] if x else 0) for u, x in known.items()}
    assert dict(rows("event_counts")) == Counter(e.event_type for e in events)
    kinds = Counter(e.event_type for e in events)
    assert rows("bulk_summary") == [(kinds["purchase"], kinds["error"], kinds["view"])]
    assert dict(rows("event_dispatch")) == {"a": kinds["view"] + kinds["error"], "b": kinds["view"]}
    assert dict(rows("bulk_progress")) == {e.event_id: (i + 1) * 100 // len(x) for x in by.values() for i, e in enumerate(x)}
    pairs, kinds = [], {"purchase": "success", "error": "error"}
    for u, x in by.items():
        told = [e for e in x if e.event_type in ("view", *kinds)]
        for a, b in zip(told, [*told[1:], None], strict=True):
            if a.event_type == "view":
                ends = b and b.event_type != "view" and (b.ts - a.ts).total_seconds() <= 2 * 86400
                pairs.append((u, a.event_id, b.event_id if ends else None, kinds[b.event_type] if ends else "failed"))
    assert sorted(rows("batch_pairing"), key=repr) == sorted(pairs, key=repr)
    cut = {u: next((i for i, e in enumerate(x) if e.event_type in ("purchase", "error")), len(x)) for u, x in by.items()}
    assert sorted(rows("log_stream")) == sorted((u, e.event_id) for u, x in by.items() for e in x[: cut[u] + 1])
    errors = {u: [e.event_id for e in x if not good(e)][-10:] for u, x in by.items()}
    assert rows("last_errors") == [(u, i) for u in sorted(errors) for i in errors[u]]
    sessions = {}
    for u, x in by.items():
        tries, captures, lost = 0, 0, []
        for e in x:
            if captures == 5 or (e.ts - x[0].ts).total_seconds() >= 10 * 86400:
                break
            tries, captures = tries + 1, captures + good(e)
            lost += [] if good(e) else [str(captures + 1)]
        sessions[u] = (tries, captures, tries - captures, pytest.approx(100 * captures / tries, abs=1e-3), ",".join(lost[-10:]))
    assert {r[0]: r[1:] for r in rows("monitor_sessions")} == sessions
    spans = {u: int(x[-1].ts.timestamp()) - int(x[0].ts.timestamp()) for u, x in by.items()}
    assert {r[0]: r[3] for r in rows("monitor_stats")} == spans
    bars = {}
    for x in by.values():
        for i, e in enumerate(x, 1):
            filled = int(40 * (100 * i / len(x)) / 100)
            bars[e.event_id] = f"[{'█' * filled}{'░' * (40 - filled)}] {100 * i / len(x):5.1f}% - {e.event_type:<20}"
    assert dict(rows("progress_bar")) == bars


def test_captures(rows, docs):
    size = sum(d.n_chars for d in docs)
    pages = {d.source for d in docs}
    assert rows("storage_stats") == [(len(docs), size, round(size / 2**20, 2), len(pages))]
    old = [d for d in docs if d.doc_id % 2]
    assert rows("retention_expired") == [(len(old),)]
    ((total, today, n, mb),) = rows("gallery_stats")
    assert (total, today, n) == (len(docs), len(docs) - len(old), len(pages)) and mb == round(size / 2**20, 2)
    first = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        first.setdefault((d.source, d.text), d.doc_id)
    assert sorted(rows("detect_duplicates")) == sorted((d.doc_id, first[d.source, d.text]) for d in docs if first[d.source, d.text] != d.doc_id)
    assert date(2024, 1, 30) > date(2024, 1, 1)


def test_catalogue(rows, events):
    visits = Counter(e.user_id % 20 for e in events)
    sites = rows("site_catalogue")
    assert len(sites) == len({s[0] for s in sites}) == 20 and sorted(s[4] for s in sites) == sorted(visits[i] for i in range(20))
    assert Counter(s[1] for s in sites) == {"static": 3, "server-rendered": 4, "single-page-app": 3, "hybrid": 3, "heavy-javascript": 3, "special-case": 4}
    assert Counter(s[2] for s in sites) == {"easy": 3, "medium": 6, "hard": 6, "very hard": 5}
    own = {s[0]: s[4] for s in sites}
    assert own["Example.com"] == visits[0] and own["MDN Web Docs"] == visits[19] and own["Vue.js"] == visits[8]
    by = defaultdict(list)
    for s in sites:
        by[s[1], s[2]].append(s[4])
    assert sorted(rows("site_counts")) == sorted((c, d, len(n), sum(n)) for (c, d), n in by.items())
    assert sorted(rows("sites_by_difficulty")) == sorted((s[0], s[4]) for s in sites if s[2] == "hard")
    assert sorted(rows("custom_set")) == [("Example.com", 2, visits[0]), ("Vue.js", 1, visits[8])]
    assert Counter(r[0] for r in rows("union_sites")) == Counter({s[0]: s[4] for s in sites if s[1] in ("static", "server-rendered")})
    sets = sorted(rows("named_sets"))
    assert [r[2] for r in sets if r[0] == "quick"] == ["Example.com", "React.dev", "WordPress.org"] and [r[3] for r in sets if r[2] == "WordPress.org"] == [0]
    assert [r[2] for r in sets if r[0] == "competitive"] == ["Example.com", "WordPress.org News", "React.dev", "Vue.js", "Tailwind CSS"]
    assert [s[0] for s in sites_named(["vue.js", "NUXT"])] == ["Vue.js", "Nuxt"]
    with pytest.raises(ValueError, match="no such sites: x"):
        sites_named(["Nuxt", "x"])
