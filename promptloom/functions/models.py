"""Model labels, tiers and prices.

The two tiers are plain arguments, so a price lookup is a conditional expression: nothing is joined
or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import fixed_values as V
from promptloom.functions.columns import as_column

PER_MILLION = 1_000_000


@dataclass(frozen=True)
class Tier:
    """A model with its relative weight and its USD prices per million tokens."""

    model: str
    weight: float
    usd_per_1m_input: float
    usd_per_1m_output: float


@dataclass(frozen=True)
class Pricing:
    """Light and heavy tier of one provider; any model that is not the heavy one is light."""

    provider: str
    light: Tier
    heavy: Tier

    @property
    def is_local(self) -> bool:
        return is_local_provider(self.provider)

    def is_heavy(self, model: Column | str) -> Column:
        return F.coalesce(as_column(model) == self.heavy.model, F.lit(False))

    def weight(self, model: Column | str) -> Column:
        """Relative cost of one token."""
        return F.when(self.is_heavy(model), self.heavy.weight).otherwise(self.light.weight)

    def cloud_usd(self, tier: Tier) -> tuple[float, float]:
        """USD per input and output token at cloud prices, whatever the provider."""
        return tier.usd_per_1m_input / PER_MILLION, tier.usd_per_1m_output / PER_MILLION

    def paid_usd(self, tier: Tier) -> tuple[float, float]:
        """USD per input and output token actually paid; nothing on a local provider."""
        return (0.0, 0.0) if self.is_local else self.cloud_usd(tier)

    def usd_columns(self, model: Column | str, paid: bool = True) -> tuple[Column, Column]:
        """Input and output USD per token of each row's model."""
        price = self.paid_usd if paid else self.cloud_usd
        heavy, light = price(self.heavy), price(self.light)
        return tuple(
            F.when(self.is_heavy(model), h).otherwise(l) for h, l in zip(heavy, light, strict=True)
        )


def is_local_provider(provider: str | None) -> bool:
    """Only the cloud provider's exact name (blanks and case aside) is not local."""
    return (provider or "local").strip().lower() != V.CLOUD_PROVIDER


def resolve_provider(provider: Column | str) -> Column:
    """Provider column reduced to ``local`` or the cloud provider."""
    name = F.lower(F.trim(F.coalesce(as_column(provider), F.lit(""))))
    return F.when(name == V.CLOUD_PROVIDER, V.CLOUD_PROVIDER).otherwise(F.lit("local"))


def default_pricing(provider: str = "local") -> Pricing:
    """Default models and prices of a provider."""
    local = is_local_provider(provider)
    light = V.LOCAL_LIGHT_MODEL if local else V.CLOUD_LIGHT_MODEL
    heavy = V.LOCAL_HEAVY_MODEL if local else V.CLOUD_HEAVY_MODEL
    return Pricing(
        "local" if local else V.CLOUD_PROVIDER,
        Tier(light, V.LIGHT_WEIGHT, *V.LIGHT_USD_PER_1M),
        Tier(heavy, V.HEAVY_WEIGHT, *V.HEAVY_USD_PER_1M),
    )


def short_model(model: Column | str) -> Column:
    """Model label: ``name:tag`` ids with at most one dot stay, others show their last dot segment."""
    model = F.coalesce(as_column(model), F.lit(""))
    dots = F.length(model) - F.length(F.replace(model, F.lit("."), F.lit("")))
    keep = F.contains(model, F.lit(":")) & (dots <= 1)
    return F.when(keep, model).otherwise(F.substring_index(model, ".", -1))
