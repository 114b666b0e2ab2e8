from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import serial
from assaylake import schemas
from assaylake.operators import accounts

T0 = datetime(2024, 1, 1)
NAMES = ["a", "A", "á", "b", "B", "ab", "aB", "c", "d", "e"]


def make_users(spark, people):
    """people: (id, name, role, active)"""
    full = [(i, n, f"{i}@x.org", "h", r, a, T0, None) for i, n, r, a in people]
    return spark.createDataFrame(full, schemas.USER)


def make_patches(spark, items):
    """items: dicts with seq, user_id and fields."""
    names = schemas.PATCH_REQUEST.names
    return spark.createDataFrame(
        [tuple(i.get(n) for n in names) for i in items], schemas.PATCH_REQUEST
    )


def make_registrations(spark, items):
    full = [(s, n, "m@x.org", "h", T0) for s, n in items]
    return spark.createDataFrame(full, schemas.REGISTER_REQUEST)


BASE = [(1, "bob", "user", True), (2, "Élan", "user", True), (3, "carl", "admin", False)]


def test_register_edges(spark, rows):
    users = make_users(spark, BASE)
    items = [
        (10, "BOB", "m@x.org", "h"),
        (11, "new", "m@x.org", "h"),
        (12, "NEW", "m@x.org", "h"),
        (13, "", "m@x.org", "h"),
        (14, "", "m@x.org", "h"),
        (15, "elan", "m@x.org", "h"),
        (16, "x" * 65, "m@x.org", "h"),
        (17, "last", "broken", "h"),
        (18, "last", "m@x.org", "h"),
        (19, None, "m@x.org", None),
        (20, "bob ", "m@x.org", "h"),
    ]
    requests = spark.createDataFrame([(*i, T0) for i in items], schemas.REGISTER_REQUEST)
    new = accounts.register(requests, users)
    assert rows(new, "seq", "id", "username", "role", "is_active", "last_login_at") == [
        (11, 4, "new", "user", True, None),
        (13, 5, "", "user", True, None),
        (18, 6, "last", "user", True, None),
        (20, 7, "bob ", "user", True, None),
    ]
    answers = accounts.registration_answers(requests, users)
    got = {r["seq"]: (r["status"], r["errors"]) for r in answers.collect()}
    assert {s for s, (status, _) in got.items() if status == 201} == {11, 13, 18, 20}
    assert got[10] == (400, []) and got[12] == (400, []) and got[15] == (400, [])
    assert got[16] == (422, ["username_too_long"]) and got[17] == (422, ["email_invalid"])
    assert got[19] == (422, ["username_missing", "password_missing"])


def test_register_into_empty_table(spark, rows):
    users = make_users(spark, []) 
    new = accounts.register(make_registrations(spark, [(7, "x"), (5, "y")]), users)
    assert rows(new, "seq", "id") == [(5, 1), (7, 2)]


def test_patch_edges(spark, rows):
    users = make_users(spark, BASE)
    patches = make_patches(
        spark,
        [
            {"seq": 1, "user_id": 99, "role": "admin"},
            {"seq": 2, "user_id": 1},
            {"seq": 3, "user_id": 1, "username": "", "role": "chief"},
            {"seq": 4, "user_id": 1, "username": "bob"},
            {"seq": 5, "user_id": 1, "username": "BOB", "email": "lost@x.org"},
            {"seq": 6, "user_id": 2, "username": "Carl", "email": "lost@x.org"},
            {"seq": 7, "user_id": 2, "is_active": False},
            {"seq": 8, "user_id": 2, "email": "broken"},
            {"seq": 9, "user_id": 3, "username": "dora", "last_login_at": datetime(2024, 5, 5)},
            {"seq": 10, "user_id": 3, "username": "dora"},
            {"seq": 11, "user_id": 3, "username": "Dora"},
            {"seq": 12, "user_id": 1, "username": "dora"},
            {"seq": 13, "user_id": 1, "role": "r" * 33},
            {"seq": 14, "user_id": 98, "email": "broken"},
        ],
    )
    decided = accounts.decide_patches(patches, users)
    assert {r["seq"]: r["status"] for r in decided.collect()} == {
        1: 404, 2: 200, 3: 200, 4: 200, 5: 400, 6: 400, 7: 200, 8: 422, 9: 200, 10: 200,
        11: 400, 12: 400, 13: 422, 14: 422,
    }
    after = accounts.apply_patches(users, decided)
    assert after.schema.names == schemas.USER.names
    assert rows(after, "id", "username", "email", "role", "is_active", "last_login_at") == [
        (1, "bob", "1@x.org", "chief", True, None),
        (2, "Élan", "2@x.org", "user", False, None),
        (3, "dora", "3@x.org", "admin", False, datetime(2024, 5, 5)),
    ]


def test_delete(spark, rows):
    users = make_users(spark, BASE)
    requests = spark.createDataFrame([(5, 1), (4, 1), (6, 77), (9, 3)], schemas.DELETE_REQUEST)
    assert rows(accounts.decide_deletes(requests, users), "seq", "status") == [
        (4, 204), (5, 404), (6, 404), (9, 204)
    ]
    assert rows(accounts.apply_deletes(users, requests), "id") == [(2,)]
    audit = spark.createDataFrame(
        [(1, 1, "bob", "::1", True, T0), (2, None, "who", None, False, T0), (3, 2, "elan", None, True, T0)],
        schemas.AUDIT,
    )
    released = accounts.release_audit(audit, requests)
    assert released.schema.names == schemas.AUDIT.names
    assert rows(released, "id", "user_id", "username") == [(1, None, "bob"), (2, None, "who"), (3, 2, "elan")]


def test_lookup(spark, rows):
    users = make_users(spark, BASE)
    requests = spark.createDataFrame([(1, 2), (2, 9), (3, 2)], "seq long, id long")
    found = accounts.find_by_id(requests, users)
    assert "password_hash" not in found.columns
    assert rows(found, "seq", "status", "username") == [(1, 200, "Élan"), (2, 404, None), (3, 200, "Élan")]
    by_name = spark.createDataFrame([("ELAN",), ("nobody",)], "username string")
    assert rows(accounts.find_by_name(by_name, users), "username", "id") == [("ELAN", 2), ("nobody", None)]
    assert accounts.public_view(users).columns == schemas.PUBLIC_USER


people = st.lists(st.sampled_from(NAMES), min_size=1, max_size=4, unique_by=serial.key)
wishes = st.lists(
    st.tuples(
        st.integers(0, 4),
        st.sampled_from([None, "", *NAMES]),
        st.sampled_from([None, "r1", "r2"]),
    ),
    max_size=8,
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(people, wishes), min_size=60, max_size=60))
def test_patches_like_one_by_one(spark, cases):
    """Many small batches side by side, kept apart by a prefix of names and ids."""
    users, items, expected_status, expected_users = [], [], {}, {}
    plain = 0
    for number, (names, asked) in enumerate(cases):
        tag = f"{number}:"
        mine = {number * 100 + i: (tag + n, "user") for i, n in enumerate(names)}
        requests = [
            (number * 1000 + s, number * 100 + who, tag + name if name else name, role)
            for s, (who, name, role) in enumerate(asked)
        ]
        users += [(i, n, r, True) for i, (n, r) in mine.items()]
        items += [
            {"seq": s, "user_id": w, "username": n, "role": r} for s, w, n, r in requests
        ]
        status, after = serial.patch_as_set(mine, requests)
        one_by_one, one_after, chained = serial.patch(mine, requests)
        if not chained:
            plain += 1
            assert (status, after) == (one_by_one, one_after)
        expected_status |= status
        expected_users |= after
    table = make_users(spark, users)
    decided = accounts.decide_patches(make_patches(spark, items), table)
    assert {r["seq"]: r["status"] for r in decided.collect()} == expected_status
    after = accounts.apply_patches(table, decided)
    assert {r["id"]: (r["username"], r["role"]) for r in after.collect()} == expected_users
    assert len({serial.key(n) for n, _ in expected_users.values()}) == len(expected_users)
    assert plain > 0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(people, st.lists(st.sampled_from(NAMES), max_size=8)), min_size=60, max_size=60))
def test_registrations_like_one_by_one(spark, cases):
    users, items, expected = [], [], {}
    for number, (names, asked) in enumerate(cases):
        tag = f"{number}:"
        users += [(number * 100 + i, tag + n, "user", True) for i, n in enumerate(names)]
        requests = [(number * 1000 + s, tag + n) for s, n in enumerate(asked)]
        items += requests
        expected |= serial.register([tag + n for n in names], requests)
    requests = make_registrations(spark, items)
    table = make_users(spark, users)
    answers = accounts.registration_answers(requests, table)
    assert {r["seq"]: r["status"] == 201 for r in answers.collect()} == expected
    new = accounts.register(requests, table).orderBy("seq").collect()
    top = max(u[0] for u in users)
    assert [r["seq"] for r in new] == sorted(s for s, ok in expected.items() if ok)
    assert [r["id"] for r in new] == list(range(top + 1, top + 1 + len(new)))
