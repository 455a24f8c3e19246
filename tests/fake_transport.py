"""A service in files, for tests: <root>/<feed>.json holds {unit: [item, ...]}, a change log of the same items; it logs its requests."""

import json
import os
import uuid


class Service:
    def __init__(self, options):
        self.root, self.size = options["root"], int(options.get("size", 2))
        self.broken = options.get("broken", "")

    def _feed(self, feed):
        with open(f"{self.root}/{feed}.json") as f:
            return json.load(f)

    def _log(self, text):
        os.makedirs(f"{self.root}/log", exist_ok=True)
        with open(f"{self.root}/log/{uuid.uuid4().hex}", "w") as f:
            f.write(text)

    def units(self, feed):
        return list(self._feed(feed))

    def page(self, feed, unit, token, since):
        self._log(f"{feed} {unit} {token} {since}")
        flag = f"{self.root}/failed-{feed}-{unit}-{token}"
        if self.broken == feed or (self.broken == "once" and token and not os.path.exists(flag)):
            open(flag, "w").close()
            raise ConnectionError("the page isn't there")
        at = int(token or 0)
        items = [i for i in self._feed(feed)[unit] if not i.get("deleted") and (since is None or i["updated"] >= since)]
        return {"items": items[at : at + self.size], "next": str(at + self.size) if at + self.size < len(items) else None}

    def head(self, feed, unit):
        return str(len(self._feed(feed)[unit]))

    def changes(self, feed, unit, token, until):
        at = int(token or 0)
        to = min(at + self.size, int(until))
        self._log(f"changes {feed} {unit} {at} {to}")
        return {"items": self._feed(feed)[unit][at:to], "next": str(to)}
