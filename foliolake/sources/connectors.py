"""Descriptions of remote sources. They check their settings; fetching needs a network and is left to the user's ``fetch``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd


class ConnectorError(Exception):
    pass


@dataclass
class Connector:
    """A named remote source: settings that must be there, and a function that yields (path, content) pairs.

    With ``names``, which lists what there is, ``fetch`` is called in the workers, with the settings and one name,
    and returns its content; only names pass the driver.
    """

    name: str
    settings: dict[str, str]
    required: tuple[str, ...] = ()
    fetch: Callable | None = field(default=None, repr=False)
    names: Callable[[dict[str, str]], Iterable[str]] | None = field(default=None, repr=False)

    def validate(self) -> bool:
        return all(self.settings.get(k) for k in self.required) and ("repo" not in self.required or "/" in self.settings["repo"])

    def files(self, spark):
        """(path, content) rows, for ``files.sections_of``."""
        if not self.validate():
            raise ConnectorError(f"{self.name}: settings {', '.join(self.required)} are needed")
        if self.fetch is None:
            raise ConnectorError(f"{self.name}: no fetch function was given")
        if self.names is None:
            return spark.createDataFrame(list(self.fetch(self.settings)), "path string, content binary")
        settings, fetch = self.settings, self.fetch

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"path": b["path"], "content": [fetch(settings, p) for p in b["path"]]})

        listed = spark.createDataFrame([(n,) for n in self.names(self.settings)], "path string")
        return listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "path string, content binary")


def github(token: str, repo: str, fetch=None, names=None) -> Connector:
    return Connector("github", {"token": token, "repo": repo}, ("token", "repo"), fetch, names)


def confluence(base_url: str, token: str, space_key: str, fetch=None, names=None) -> Connector:
    return Connector("confluence", {"base_url": base_url, "token": token, "space_key": space_key}, ("base_url", "token", "space_key"), fetch, names)


def jira(base_url: str, token: str, project_key: str, fetch=None, names=None) -> Connector:
    return Connector("jira", {"base_url": base_url, "token": token, "project_key": project_key}, ("base_url", "token", "project_key"), fetch, names)


def notion(token: str, page_id: str, fetch=None, names=None) -> Connector:
    return Connector("notion", {"token": token, "page_id": page_id}, ("token", "page_id"), fetch, names)
