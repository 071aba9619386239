"""The store's verbs over HTTP, for a server that offers them below ``/api/v1``."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from typing import Any


class RemoteLake:
    """Verbs as requests; a status that isn't 2xx raises ``OSError`` with the server's text."""

    def __init__(self, url: str, key: str | None = None, timeout: float = 10.0):
        self.url, self.key, self.timeout = url.rstrip("/") + "/api/v1", key, timeout

    def _ask(self, method: str, path: str, body: dict | None = None, **query: Any) -> Any:
        asked = urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = None if body is None else json.dumps({k: v for k, v in body.items() if v is not None}).encode()
        request = urllib.request.Request(f"{self.url}{path}" + (f"?{asked}" if asked else ""), data, headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read() or b"null")
        except urllib.error.HTTPError as e:
            raise OSError(f"{method} {path}: {e.code} {e.read().decode(errors='replace')}") from e

    def remember(self, session_id: str, content: str, role: str = "user", metadata: dict | None = None) -> dict:
        return self._ask("POST", "/memories", {"sessionId": session_id, "content": content, "role": role, "metadata": metadata})

    def recall(self, session_id: str, query: str | None = None, limit: int = 10, **options: Any) -> list[dict]:
        return self._ask("GET", "/memories", sessionId=session_id, query=query, limit=limit, **options)["results"]

    def history(self, session_id: str, limit: int = 20) -> list[dict]:
        return self._ask("GET", "/memories/history", sessionId=session_id, limit=limit)["entries"]

    def forget(self, session_id: str, **options: Any) -> int:
        return self._ask("DELETE", "/memories", sessionId=session_id, **options)["deleted"]

    def stats(self, session_id: str) -> dict:
        return self._ask("GET", "/memories/stats", sessionId=session_id)

    def consolidate(self, session_id: str, **options: Any) -> dict:
        return self._ask("POST", "/memories/consolidate", {"sessionId": session_id, **options})

    def remember_user(self, user_id: str, content: str, role: str = "user", metadata: dict | None = None) -> dict:
        return self._ask("POST", "/user/memories", {"userId": user_id, "content": content, "role": role, "metadata": metadata})

    def recall_user(self, user_id: str, query: str | None = None, limit: int = 10, **options: Any) -> list[dict]:
        return self._ask("GET", "/user/memories", userId=user_id, query=query, limit=limit, **options)["results"]

    def forget_user(self, user_id: str, **options: Any) -> int:
        return self._ask("DELETE", "/user/memories", userId=user_id, **options)["deleted"]

    def consolidate_user(self, user_id: str, **options: Any) -> dict:
        return self._ask("POST", "/user/memories/consolidate", {"userId": user_id, **options})

    def user_stats(self, user_id: str) -> dict:
        return self._ask("GET", "/user/memories/stats", userId=user_id)

    def close(self) -> None:
        """Requests keep no connection."""
