"""The registered queries; importing the package registers them all."""

from gridloom.plans import layers, network, places, registry, scoring, zones  # isort: skip
from gridloom.plans import hazards  # isort: skip  (its SQL is made of theirs)

__all__ = ["hazards", "layers", "network", "places", "registry", "scoring", "zones"]
