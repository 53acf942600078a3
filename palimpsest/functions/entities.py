"""Kinds of sensitive text, and the switches that turn their masking on and off."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Names by id, from 1. They stand in placeholders, so they never change. Fixed values.
ENTITIES = (
    "PHYSICAL_ADDRESS",
    "EMAIL_ADDRESS",
    "ORGANIZATION",
    "USER_NAME",
    "PHONE_NUMBER",
    "BANK_NUMBER",
    "PAYMENT",
    "VERIFICATION_CODE",
    "PASSWORD",
    "RANDOM_SEED",
    "PRIVATE_KEY",
    "URL_ADDRESS",
)
TYPE_ID = {name: i for i, name in enumerate(ENTITIES, 1)}
#: Keys of a switch patch, in the order of ENTITIES. Fixed values.
PATCH_KEYS = (
    "maskAddress",
    "maskEmail",
    "maskOrganization",
    "maskUserName",
    "maskPhoneNumber",
    "maskBankNumber",
    "maskPayment",
    "maskVerificationCode",
    "maskPassword",
    "maskRandomSeed",
    "maskPrivateKey",
    "maskUrl",
)


@dataclass(frozen=True)
class Switches:
    """A bit for each kind: bit id - 1. By default all but addresses are masked."""

    bits: int = (1 << len(ENTITIES)) - 2

    @classmethod
    def all(cls) -> Switches:
        return cls((1 << len(ENTITIES)) - 1)

    @classmethod
    def none(cls) -> Switches:
        return cls(0)

    def enabled(self, kind: str) -> bool:
        return bool(self.bits >> (TYPE_ID[kind] - 1) & 1)

    def set(self, kind: str, on: bool) -> Switches:
        bit = 1 << (TYPE_ID[kind] - 1)
        return Switches(self.bits | bit if on else self.bits & ~bit)

    def enable(self, kind: str) -> Switches:
        return self.set(kind, True)

    def disable(self, kind: str) -> Switches:
        return self.set(kind, False)

    def patched(self, patch: Mapping[str, bool | None]) -> Switches:
        """maskAll first, then single keys; keys that are unknown or None change nothing."""
        out = self
        if patch.get("maskAll") is not None:
            out = Switches.all() if patch["maskAll"] else Switches.none()
        for key, kind in zip(PATCH_KEYS, ENTITIES, strict=True):
            if patch.get(key) is not None:
                out = out.set(kind, bool(patch[key]))
        return out


def entity_table(spark: SparkSession) -> DataFrame:
    """(type_id, type) of every kind."""
    return spark.createDataFrame([(i, name) for name, i in TYPE_ID.items()], "type_id tinyint, type string")
