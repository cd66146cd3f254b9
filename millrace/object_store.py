"""Object stores as settings of Spark's file systems."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class AmazonS3:
    bucket_name: str
    region: str | None = None
    access_key_id: str | None = None
    secret_access_key: str | None = None
    endpoint: str | None = None
    allow_http: bool = False

    def settings(self, host: str | None = None) -> dict[str, str]:
        p = f"fs.s3a.bucket.{host or self.bucket_name}."
        all_ = {"endpoint.region": self.region, "access.key": self.access_key_id, "secret.key": self.secret_access_key, "endpoint": self.endpoint, "connection.ssl.enabled": str(not self.allow_http).lower()}
        return {p + k: v for k, v in all_.items() if v}


@dataclass
class GoogleCloud:
    bucket_name: str
    service_account_path: str | None = None

    def settings(self, host: str | None = None) -> dict[str, str]:
        if not self.service_account_path:
            return {}
        return {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": self.service_account_path}


@dataclass
class MicrosoftAzure:
    container_name: str
    account: str
    access_key: str | None = None

    def settings(self, host: str | None = None) -> dict[str, str]:
        return {f"fs.azure.account.key.{self.account}.dfs.core.windows.net": self.access_key} if self.access_key else {}


@dataclass
class LocalFileSystem:
    prefix: str | None = None

    def settings(self, host: str | None = None) -> dict[str, str]:
        return {}
