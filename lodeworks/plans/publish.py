"""Publishers over HTTP sessions that are passed in. One that isn't configured does nothing; failures are told by the
result, never raised."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

LOG = logging.getLogger(__name__)
TIMEOUT_S = 30
#: The service answers so when it has made something, and so when a label is there already.
CREATED, EXISTS, OK = 201, 422, 200
PAGE = 100


class Issues:
    """An issue tracker with GitHub's interface. session has get and post as the requests library has them."""

    def __init__(self, session: Any, env: Mapping[str, str]):
        self.session, self.token, self.repo = session, env.get("GITHUB_TOKEN", ""), env.get("GITHUB_REPOSITORY", "")
        self.root = env.get("GITHUB_API_URL", "https://api.github.com")
        self.done: set[str] = set()

    @property
    def enabled(self) -> bool:
        return bool(self.token and self.repo)

    def _call(self, method: str, path: str, **more: Any) -> Any | None:
        """The response, or None if there is no configuration or no answer."""
        if not self.enabled:
            return None
        headers = {"Authorization": f"Bearer {self.token}", "Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}
        try:
            return getattr(self.session, method)(f"{self.root}/repos/{self.repo}{path}", headers=headers, timeout=TIMEOUT_S, **more)
        except Exception as e:  # noqa: BLE001  whatever a session raises
            LOG.warning("%s %s failed: %s", method, path, e)
            return None

    def ensure_labels(self, labels: list[tuple[str, str, str]]) -> None:
        """Creates the labels (name, colour, description) that this object hasn't seen; those that exist are fine."""
        for name, colour, description in labels:
            if name in self.done:
                continue
            r = self._call("post", "/labels", json={"name": name, "color": colour, "description": description})
            if r is not None and r.status_code in (CREATED, EXISTS):
                self.done.add(name)

    def create_issue(self, title: str, body: str, labels: list[str]) -> int | None:
        r = self._call("post", "/issues", json={"title": title, "body": body, "labels": labels})
        if r is None or r.status_code != CREATED:
            LOG.error("no issue %r: %s", title, None if r is None else r.status_code)
            return None
        return r.json().get("number")

    def open_titles(self, label: str) -> list[str]:
        r = self._call("get", "/issues", params={"labels": label, "state": "open", "per_page": PAGE})
        return [x.get("title", "") for x in r.json()] if r is not None and r.status_code == OK else []


class Messages:
    """A bot with Telegram's interface."""

    def __init__(self, session: Any, env: Mapping[str, str], root: str = "https://api.telegram.org"):
        self.session, self.token, self.chat, self.root = session, env.get("TELEGRAM_BOT_TOKEN", ""), env.get("TELEGRAM_CHAT_ID", ""), root

    @property
    def enabled(self) -> bool:
        return bool(self.token and self.chat)

    def send_message(self, text: str) -> bool:
        if not self.enabled:
            return False
        try:
            r = self.session.post(f"{self.root}/bot{self.token}/sendMessage", json={"chat_id": self.chat, "text": text, "disable_web_page_preview": True}, timeout=TIMEOUT_S)
        except Exception as e:  # noqa: BLE001
            LOG.warning("no message sent: %s", e)
            return False
        return r.status_code == OK


class Services(Issues):
    """Both, as one report.Publisher."""

    def __init__(self, session: Any, env: Mapping[str, str]):
        super().__init__(session, env)
        self.messages = Messages(session, env)

    def send_message(self, text: str) -> bool:
        return self.messages.send_message(text)
