"""Requests applied one after the other on plain dicts, as an expectation for batches."""

import unicodedata


def key(name):
    decomposed = unicodedata.normalize("NFD", name)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).casefold()


def register(names, requests):
    """names: existing; requests: (seq, name). Returns {seq: accepted}."""
    used = {key(n) for n in names}
    answer = {}
    for seq, name in sorted(requests):
        answer[seq] = key(name) not in used
        used.add(key(name))
    return answer


def patch(users, requests):
    """users: {id: (name, role)}; requests: (seq, id, name, role).

    Returns ({seq: status}, users afterwards, whether a name was given up and asked for
    again).
    """
    users, answer, given_up, chained = dict(users), {}, set(), False
    for seq, who, name, role in sorted(requests, key=lambda r: r[0]):
        if who not in users:
            answer[seq] = 404
            continue
        own, own_role = users[who]
        if name and name != own:
            chained |= key(name) in given_up
            if any(key(name) == key(other) for other, _ in users.values()):
                answer[seq] = 400
                continue
            given_up.add(key(own))
            own = name
        users[who] = (own, own_role if role is None else role)
        answer[seq] = 200
    return answer, users, chained


def patch_as_set(users, requests):
    """The same with names compared to the start of the batch; first claim wins."""
    start = {key(name) for name, _ in users.values()}
    after, answer, claims = dict(users), {}, {}
    for seq, who, name, role in sorted(requests, key=lambda r: r[0]):
        if who not in users:
            answer[seq] = 404
            continue
        if name and name != users[who][0]:
            first = claims.setdefault(key(name), (who, name))
            if key(name) in start or first != (who, name):
                answer[seq] = 400
                continue
        own, own_role = after[who]
        after[who] = (name or own, own_role if role is None else role)
        answer[seq] = 200
    return answer, after


def login(users, attempts):
    """users: {id: (name, active)}; attempts: (seq, name, password_ok, time).

    Returns [(seq, user id or None, ok)] and {id: last login}.
    """
    by_key = {key(name): (who, active) for who, (name, active) in users.items()}
    audit, last = [], {}
    for seq, name, password_ok, time in sorted(attempts):
        who, active = by_key.get(key(name), (None, False))
        ok = who is not None and active and password_ok
        audit.append((seq, who, ok))
        if ok:
            last[who] = time
    return audit, last
