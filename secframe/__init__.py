"""secframe: security-event analytics as Spark DataFrame jobs.

Raw logs -> one normalized event table -> rule hits in a single scan -> alerts ->
scored alerts -> incidents -> response plan -> metrics.  Every step takes DataFrames and
returns DataFrames; nothing here loops over collected rows.
"""
from secframe.plans.rules import Rule, load_rules
from secframe.plans.detect import detect

__all__ = ["Rule", "load_rules", "detect"]
