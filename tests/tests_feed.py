"""Random heap feeds and what they come to, by plain Python."""

HEAP = "rel_oid bigint, page_no bigint, item_no int, row_id bigint, t_xmin bigint, t_xmax bigint, t_infomask int, page_lsn bigint, val_text string"
CLOG = "xid bigint, status int, seen_ts timestamp_ntz"


def brute(heap, clog):
    log = {}
    for xid, status, ts in clog:
        if xid is not None:
            log[xid] = max(log.get(xid, (ts, status)), (ts, status))
    status = {x: s for x, (_, s) in log.items()}
    images = {}
    for rel, page, item, row, xmin, xmax, mask, lsn, _ in heap:
        if None in (rel, page, item):
            continue
        k = (rel, page, item)
        if k not in images or (lsn if lsn is not None else -1) > images[k][0]:
            images[k] = (lsn if lsn is not None else -1, row, xmin, xmax or 0, mask or 0)
    rows = {}
    for k, (_, row, xmin, xmax, mask) in images.items():
        held = bool(mask & 0x100) or (not mask & 0x200 and ((xmin is not None and xmin < 3) or status.get(xmin) not in (0, 2)))
        if held:
            rank = (xmin if xmin is not None else -1, k[1], k[2])
            if (k[0], row) not in rows or rank > rows[k[0], row][0]:
                rows[k[0], row] = (rank, k, xmax, mask)
    out = set()
    for _, k, xmax, mask in rows.values():
        if mask & 0x880:
            gone = False
        elif mask & 0x1400:
            gone = True
        else:
            gone = xmax != 0 and (xmax < 3 or status.get(xmax) in (1, 3))
        if not gone:
            out.add(k)
    return out


def feed(rng, n):
    import datetime

    day = datetime.datetime(2031, 1, 1)
    heap = []
    for i in range(n):
        # one lsn, one image: equal ones agree
        heap.append((rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 3), rng.randint(1, 5), rng.choice([7, 7, 8, 9, None]), rng.choice([1, 2, *range(100, 140)]), rng.choice([0, 0, 2, None, *range(100, 140)]), rng.choice([0, 0x100, 0x200, 0x300, 0x900, 0x500, 0x1100, 0x80, 0x400, None]), i, None if i % 9 == 0 else "v" * (i % 5000)))
    heap += rng.sample(heap, n // 5)
    clog = [(rng.choice([None, *range(100, 140)]), rng.choice([0, 1, 2, 3]), day + datetime.timedelta(hours=i)) for i in range(60)]
    rng.shuffle(heap)
    return heap, clog + clog[:5]
