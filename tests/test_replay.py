"""How often a URL's state is asked for and written."""

from corvane.streaming import states


class Held:
    def __init__(self, row):
        self.row, self.calls = row, []

    def exists(self):
        self.calls.append("exists")
        return self.row is not None

    def get(self):
        self.calls.append("get")
        return self.row

    def update(self, row):
        self.calls.append("update")
        self.row = row


def test_a_state_is_read_once_and_written_if_it_changed():
    ok = {"status": 200, "content_type": "text/html", "etag": '"a"', "last_modified": None, "body": "x"}
    lost = {**ok, "status": 500}
    held = ('"h"', None, 1.0, "sha", "old", 0)
    for first, row, calls, outcome in ((ok, None, ["get", "update"], "stored"), (lost, held, ["get"], "failed"), (lost, None, ["get"], "failed"), ({**ok, "status": 304}, held, ["get", "update"], "not_modified")):
        p = states.Revalidation()
        p.row = Held(row)
        told = list(p.handleInputRows(("u",), iter([{"seq": 1, "expect_html": True, "now": 2.0, "first": first, "second": None}]), None))
        assert [t["outcome"] for t in told] == [outcome] and p.row.calls == calls
        assert p.row.row is None or len(p.row.row) == 6
