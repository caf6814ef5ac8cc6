def by_id(df):
    """The rows by doc_id; fails on an id with two rows."""
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found
