"""Parts of pages leave a task a few pages at a time, however many come in a batch."""

import pandas as pd

from storyline.sources import pages


def test_parts_leave_in_small_frames():
    rows = [(k, f"https://x{k}.org/a", f"<article><p>Text {k}</p></article>" if k % 5 else None, None) for k in range(2 * pages.PAGES + 9)]
    batch = pd.DataFrame(rows, columns=["page_id", "url", "html", "selectors"])
    got = list(pages._blocks(iter([batch, batch.iloc[:0]])))
    assert [len(x) for x in got] == [pages.PAGES, pages.PAGES, 9]
    assert [(p, t) for x in got for p, t in zip(x["page_id"], x["text"], strict=True)] == [(k, ["article", f"Text {k}"] if k % 5 else []) for k, *_ in rows]
