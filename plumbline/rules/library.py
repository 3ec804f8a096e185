"""Rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import is_blank
from plumbline.operators.execute import output
from plumbline.registry import WHOLE_RECORD, acted, amendment, consulted, issue, measure, parameter, validation

UNMET = "INTERNAL_PREREQUISITES_NOT_MET"
CLS = "rules.Orders"


@validation("urn:rule:orderstatus", acted("o_orderstatus"), cls=CLS)
def order_status_final(status):
    return F.when(is_blank(status), output(UNMET, None, "no status")).otherwise(output("RUN_HAS_RESULT", F.when(status.isin("F", "O"), "COMPLIANT").otherwise("NOT_COMPLIANT")))


@validation("urn:rule:priority", acted("o_orderpriority"), cls=CLS)
def priority_specified(priority):
    return F.when(is_blank(priority) | (priority == "4-NOT SPECIFIED"), output(UNMET, None, "not specified")).otherwise(output("RUN_HAS_RESULT", "COMPLIANT"))


@validation("urn:rule:price", acted("o_totalprice", "double"), cls=CLS)
def price_in_range(price):
    return price_below(price, F.lit(400000.0))


@validation("urn:rule:price", acted("o_totalprice", "double"), parameter("maxPrice", "double"), cls=CLS)
def price_below(price, most):
    return F.when(price.isNull(), output(UNMET)).otherwise(output("RUN_HAS_RESULT", F.when(price <= F.coalesce(most, F.lit(400000.0)), "COMPLIANT").otherwise("NOT_COMPLIANT")))


@issue("urn:rule:outlier", acted("o_totalprice", "double"), cls=CLS)
def price_outlier(price):
    return F.when(price.isNull(), output(UNMET)).otherwise(output("RUN_HAS_RESULT", F.when(price > 450000, "IS_ISSUE").when(price > 350000, "POTENTIAL_ISSUE").otherwise("NOT_ISSUE")))


@amendment("urn:rule:priorityname", acted("o_orderpriority"), cls=CLS)
def priority_standardised(priority):
    name = F.substring(priority, 3, 100)
    return (
        F.when(priority == "4-NOT SPECIFIED", output("FILLED_IN", None, None, F.create_map(F.lit("o_orderpriority"), F.lit("MEDIUM"))))
        .when(priority.rlike("^[0-9]-"), output("AMENDED", None, None, F.create_map(F.lit("o_orderpriority"), name)))
        .otherwise(output("NOT_AMENDED"))
    )


@amendment("urn:rule:queue", acted("o_orderpriority"), cls=CLS, writes=("o_queue",))
def queue_from_priority(priority):
    queue = F.when(priority.isin("URGENT", "HIGH"), "fast").otherwise("normal")
    return F.when(is_blank(priority), output("NOT_AMENDED")).otherwise(output("FILLED_IN", None, None, F.create_map(F.lit("o_queue"), queue)))


@validation("urn:rule:labelled", acted("quality"), cls="rules.Documents")
def label_present(quality):
    return F.when(quality.isNull(), output(UNMET)).otherwise(output("RUN_HAS_RESULT", "COMPLIANT"))


@measure("urn:rule:length", acted("n_chars"), cls="rules.Documents")
def text_length(n):
    return F.when(is_blank(n), output(UNMET)).otherwise(output("RUN_HAS_RESULT", n))


@measure("urn:rule:complete", acted("lang"), consulted("quality"), cls="rules.Documents")
def document_complete(lang, quality):
    return output("RUN_HAS_RESULT", F.when(is_blank(lang) | is_blank(quality), "NOT_COMPLETE").otherwise("COMPLETE"))


@validation("urn:rule:event", acted("event_type"), cls="rules.Events", native=False)
def event_allowed(event_type):
    """Runs in Python and fails on one key, to show that errors stay with their rows."""
    if event_type == "error":
        raise ValueError("not an event")
    return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT" if event_type != "signup" else "NOT_COMPLIANT"}


@validation("urn:rule:eventlength", acted("event_type"), parameter("most", "int"), cls="rules.Events", native=False)
def event_short(event_type, most):
    return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT" if len(event_type) <= (most or 5) else "NOT_COMPLIANT"}


@validation("urn:rule:wholeevent", WHOLE_RECORD, cls="rules.Events", native=False)
def event_whole(record):
    """Takes the record as a dict, so it is run for each."""
    return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT" if int(record["user_id"]) % 2 == 0 else "NOT_COMPLIANT"}
