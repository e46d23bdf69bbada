"""The whole pipeline against a record-by-record computation in plain Python on messy random data."""

import math
import random
from collections import Counter
from datetime import timedelta

import numpy as np
import pytest

from callrank.config import JobConfig, Weights
from callrank.operators.clean import clean
from callrank.operators.features import engineer_features
from callrank.operators.rank import rank_and_tier
from callrank.operators.scorers import compute_scores
from callrank.sources.crm import CrmTables
from crm_world import ACCOUNTS, CONTACTS, LEADS, MEMBERS, REFERENCE

# Fixed values of the scoring model that the plain computation uses.
LEVELS = {"C-Level": 1.0, "VP": 0.85, "Director": 0.7, "Manager": 0.5, "Individual Contributor": 0.3}
PERSONAS = {"CISO": 1.0, "Technical Buyer": 0.9, "Non-Prospect": 0.0}
TYPES = ["Webinar", "Event", "Content Syndication", "Email", "Podcast", None]
STATUSES = ["Attended", "Sent", "Responded", None]


def make(seed):
    rng = random.Random(seed)

    def maybe(value, chance=0.2):
        return None if rng.random() < chance else value

    def flag():
        return rng.choice([True, False, False, None])

    def when(span):
        return maybe(REFERENCE - timedelta(days=rng.randrange(-5, span)))

    accounts = [
        (f"A{i}", maybe(f"n{i}"), "x", maybe(rng.randrange(20000)), maybe(rng.random() * 2e9),
         flag(), flag(), maybe(float(rng.randrange(101))), flag(), "US")
        for i in range(12)
    ]
    emails = [None] + [f"e{i}@x" for i in range(40)]
    person = lambda: (maybe("t"), maybe(rng.choice(list(PERSONAS))),
                      maybe(rng.choice([*LEVELS, "Non-Prospect"])))
    leads, contacts = [], []
    for i in range(60):
        title, persona, level = person()
        leads.append((f"L{i:02}", rng.choice(emails), "f", "l", title,
                      maybe(rng.choice(["Acme", "Okta"])), rng.choice(["New", "Recycled", None]),
                      "Web", persona, level, when(4), when(90), flag(), maybe(f"C{i:02}", 0.6), 1,
                      flag(), None, when(90), flag(), flag()))
    for i in range(50):
        title, persona, level = person()
        contacts.append((f"C{i:02}", rng.choice([None, "lost"] + [f"A{k}" for k in range(12)]),
                         rng.choice(emails), "f", "l", title, "Active", persona, level, when(3),
                         when(90), 1, flag(), flag(), None, flag(), flag()))
    members = [
        (f"m{i}", rng.choice(["L00", f"L{rng.randrange(60):02}", f"C{rng.randrange(40):02}"]),
         rng.choice(["lead", "contact"]), "c", rng.choice(TYPES), rng.choice(STATUSES), flag(),
         when(200), False)
        for i in range(700)
    ]
    return accounts, leads, contacts, members


def expected(accounts, leads, contacts, members):
    known = {a[0]: a for a in accounts}
    mails = Counter([r[1] for r in leads] + [r[2] for r in contacts])
    lead_days, contact_days = Counter(r[10] for r in leads), Counter(r[9] for r in contacts)
    bulk = {d for d, n in lead_days.items() if d and n > 20}
    bulk_contacts = {d for d, n in contact_days.items() if d and n > 10}
    out = []
    for kind, rows in (("lead", leads), ("contact", contacts)):
        for r in rows:
            if kind == "lead":
                title, persona, level, email = r[4], r[8], r[9], r[1]
                excluded = bool(r[5] == "Okta" or r[18] or r[19] or persona == "Non-Prospect" or r[15])
                broken = bool(r[12] and r[13] is None)
                issues = [broken, r[11] is not None and r[6] == "Recycled", r[10] in bulk]
                account = None
            else:
                title, persona, level, email = r[5], r[7], r[8], r[2]
                account = known.get(r[1])
                excluded = bool(r[16] or r[15] or persona == "Non-Prospect" or (account and account[8]))
                broken, issues = False, [r[9] in bulk_contacts]
            issues += [mails[email] > 1, title is None or persona is None]
            mates = sorted(c[0] for c in contacts if email is not None and c[2] == email)
            mine = [m for m in members if (m[2], m[1]) == (kind, r[0])]
            real = [m for m in mine if m[6]]
            ages = [(REFERENCE - m[7]).days for m in real if m[7]]
            e30, e60, e90 = (sum(a <= d for a in ages) for d in (30, 60, 90))
            days = min(ages, default=999)
            auto = sum(m[4] == "Email" and m[5] == "Sent" for m in mine) / max(len(mine), 1)
            types = len({m[4] for m in mine} - {None})
            attended = Counter(m[4] for m in mine if m[5] == "Attended")
            content = sum(m[4] == "Content Syndication" for m in real)
            engagement = (
                (0.0 if days >= 999 else 100.0 * math.exp(-0.693 * days / 45.0)) * 0.4
                + min(e30 * 20.0 + e90 * 5.0, 100.0) * 0.3
                + min(types * 10.0, 30.0)
                + min(attended["Webinar"] * 15.0 + attended["Event"] * 20.0 + content * 10.0, 40.0)
                - auto * 30.0
            )
            profile = LEVELS.get(level, 0.2) * 50 + PERSONAS.get(persona, 0.2) * 50
            profile += ((title is not None) + (persona not in (None, "Non-Prospect"))) * 10
            before = e60 - e30
            momentum, faster = 0.0, False
            if len(real) >= 2:
                momentum = (1.0 if e30 else 0.0) if not before else min((e30 - before) / before, 2.0)
                momentum, faster = max(momentum, 0.0), e30 > before
            speed = 0.0 if not e30 else min(momentum * 40, 80) + 20 * faster
            strength = 15.0
            if account:
                _, _, _, staff, revenue, icp, named, intent, _, _ = account
                strength = None
                if None not in (staff, revenue, intent):
                    size = min(staff / 10000, 1.0) + min(revenue / 1e9, 1.0)
                    strength = bool(named) * 30 + bool(icp) * 25 + intent / 100 * 30 + size * 7.5
            clip = lambda x: None if x is None else min(max(x, 0.0), 100.0)
            parts = [clip(x) for x in (engagement, profile, strength, speed)]
            score = None
            if None not in parts:
                score = float(np.round(sum(p * w for p, w in zip(parts, (0.4, 0.25, 0.2, 0.15))), 1))
            out.append((kind, r[0], parts, score, excluded, sum(issues),
                        mates[0] if broken and mates else None))
    return sorted(out, key=lambda x: (x[3] is None, -(x[3] or 0), x[0], x[1]))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"limit": -1}, {"limit": -1, "hot_share": 0.05}])
def test_pipeline(spark, seed, options):
    rows = make(seed)
    tables = CrmTables(*[
        spark.createDataFrame(r, s) for r, s in zip(rows, (ACCOUNTS, LEADS, CONTACTS, MEMBERS))
    ])
    config = JobConfig(reference_date=REFERENCE)
    scored = compute_scores(engineer_features(clean(tables, config, **options), config), Weights())
    got = rank_and_tier(scored).orderBy("rank").collect()
    want = expected(*rows)
    assert len(got) == len(want) == 110
    for place, (row, (kind, key, parts, score, excluded, issues, link)) in enumerate(zip(got, want), 1):
        assert (row["rank"], row.entity_type, row.entity_id) == (place, kind, key)
        assert row.readiness_score == score
        ours = [row.score_engagement, row.score_profile, row.score_account, row.score_momentum]
        assert ours == [p if p is None else pytest.approx(p, abs=1e-9) for p in parts]
        assert (row.is_excluded, row.dq_issue_count, row.resolved_contact_id) == (
            excluded, issues, link,
        ), (kind, key)
