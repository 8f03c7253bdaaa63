"""Brief, report-table and prompt text.

Every text is a template with ``{placeholder}`` fields filled from the
per-entity fact row (see ``brief.PLACEHOLDERS``).  A pair ``(with_profit,
without_profit)`` gives the two variants; a plain string serves both.  Texts
state recorded figures and name a next step; they promise no results.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Section titles (in order), block field labels, priorities,
# confidences, and the industries offered.
SECTIONS = ["Executive Summary", "Key Business Findings", "Critical Risks", "Growth Opportunities",
            "Strategic Recommendations", "Expected Business Impact"]
BLOCK_FIELDS = ["Issue", "Priority", "Confidence", "Evidence", "Business Impact", "Recommendation"]
RISK_BLOCKS = [("HIGH", 92), ("MEDIUM", 85)]
OPPORTUNITY_BLOCKS = [("HIGH", 88), ("HIGH", 90)]
INDUSTRIES = ["Retail", "Banking", "Healthcare", "Manufacturing", "Technology", "SaaS", "Telecommunications"]
RULE_INDUSTRIES = ["Retail", "SaaS"]
FALLBACK_INDUSTRY = "SaaS"
DECISION_CONFIDENCE = 95
# ---------------------------------------------------------------------------

EMPTY_NOTICE = "Nothing to report: no rows are left after cleaning."

EXEC_SUMMARY = (
    "Sales of **{total_revenue}** left **{total_profit}**, which is **{profit_margin}%** of them. Month by month the "
    "figures draw {growth_statement}. No region outsells **{top_region}**, no product outsells **{top_product}**. "
    "Together these readings make **{health_score}/100** points: **{health_status}**.",
    "Sales came to **{total_revenue}**; profit was not recorded. Month by month the figures draw {growth_statement}. "
    "No region outsells **{top_region}**, no product outsells **{top_product}**. Together these readings make "
    "**{health_score}/100** points: **{health_status}**.",
)

FINDINGS = (
    "- **Best seller**: **{top_product}**, with a margin of **{top_product_margin}%** of its own.\n"
    "- **Regions**: **{top_region}** sells the most; **{worst_region}** keeps the least of what it sells.\n"
    "- **Months**: the series draws {growth_statement}.",
    "- **Best seller**: **{top_product}** with **{top_product_rev}**.\n"
    "- **Regions**: **{top_region}** sells the most, **{top_region_rev}**.\n"
    "- **Months**: the series draws {growth_statement}.",
)

INDUSTRY_TEXT = {
    "Retail": {
        "risk_name": ("Little left of {worst_product} sales", "One product carries the shop: {top_product}"),
        "risk_evidence": ("Of all products {worst_product} keeps the smallest part of its price, {worst_product_margin}%.",
                          "{top_product} alone sold {top_product_rev}."),
        "risk_impact": ("The next sale of it hardly adds to profit.", "Its bad month is everyone's bad month."),
        "risk_rec": ("Lay purchase price and shelf price side by side before the next order.",
                     "Give a second product the same display for a month."),
        "opp_name": "Earlier offers for {top_region}",
        "opp_evidence": "Tills in {top_region} took {top_region_rev0}.",
        "opp_impact": "Customers who know the range come back sooner.",
        "opp_rec": "See what is bought together in {top_region} and offer it ahead of the season.",
        "rec1": ("**Walk the shelf in {worst_region}**: decide item by item what stays.",
                 "**Walk the shelf outside {top_region}**: decide item by item what stays."),
        "rec2": ("**{worst_product}**: new price, new supplier, or no reorder.",
                 "**Season**: plan it from the receipts of {top_region}."),
        "rec3": "**Neighbours on the shelf**: put something that sells less beside {top_product} and compare receipts.",
        "impact": "Compare the next quarter with two figures of this report: sales of {total_revenue} and {health_score} points.",
    },
    "SaaS": {
        "risk_name": ("{worst_product} costs nearly what it bills", "Renewals of {top_product}"),
        "risk_evidence": ("Only {worst_product_margin}% of what customers pay for {worst_product} is left.",
                          "{top_product} bills {top_product_rev}, and each contract ends some day."),
        "risk_impact": ("Every further seat brings work, but hardly money.", "A handful of cancellations would show in the total."),
        "risk_rec": "Ask the accounts that use it least what they would miss.",
        "opp_name": "Colleagues of present users in {top_region}",
        "opp_evidence": "Accounts in {top_region} were billed {top_region_rev0}.",
        "opp_impact": "More seats without another first sale.",
        "opp_rec": "Show administrators in {top_region} which teams work without a login.",
        "rec1": "**Calendar of contracts**: one list with end date and owner.",
        "rec2": ("**Hours against bills**: set support time for {worst_region} against what it pays.",
                 "**Hours against bills**: set support time of every region against what it pays, {top_region} first."),
        "rec3": "**One plan fewer**: merge the two plans that customers mix up.",
        "impact": "Compare the next quarter with this report: contracts kept, and {health_score} points.",
    },
}

RISK2 = {
    "issue": ("{worst_region} keeps the least", "All sales outside {top_region}"),
    "evidence": ("{worst_region_margin}% of its sales remain, less than in any other region.",
                 "No other region reaches {top_region_rev}."),
    "impact": ("It pulls down what all regions keep together.", "The total moves with one region."),
    "rec": ("Put its discounts next to those of the other regions.", "Visit the customers of the second-largest region."),
}
OPP2 = {
    "issue": "A larger {top_product}",
    "evidence": "Nothing is bought more: {top_product_rev}.",
    "impact": "It meets demand that is on record.",
    "rec": "Offer one bigger or dearer version in a single region and watch.",
}

# Presentation tables
RISK_REGISTER = [
    (("{worst_product15} keeps little", "{top_product15} carries much"), "HIGH",
     ("Sales without profit.", "One bad month hits all."),
     ("Check cost and price of {worst_product15}.", "Build up a second product."), "IMMEDIATE"),
    (("Regions keep unequal parts", "{top_region15} sells most"), "MEDIUM",
     ("The average falls.", "The total follows one region."), "Lay the regions' discounts side by side.", "30 DAYS"),
]
OPPORTUNITY_TABLE = [
    ("A larger {top_product15}", ("More kept from present demand.", "More sold to present customers."), "Medium",
     "Measure after one quarter"),
    ("Earlier offers in {top_region15}", "Returning customers.", "Low", "Measure after one season"),
]
INITIATIVES = [
    (("Price check of {worst_product15}", "A second product besides {top_product15}"),
     ("Profit on later sales", "Less hangs on one name"), "HIGH", "Pricing", "6 weeks"),
    ("Visit to {top_region15}", "Habits that others can try", "HIGH", "Sales", "3 weeks"),
    ("Trial of a larger {top_product15}", "Use of present demand", "MEDIUM", "Product", "1 quarter"),
    ("Regional figures every month", "Early warning", "MEDIUM", "Finance", "2 weeks"),
    ("Calls to lost customers", "Reasons in their words", "LOW", "Service", "1 quarter"),
]
ROADMAP = [
    ("Month 1", "Look",
     [("Split the cost of {worst_product15} into parts.", "Split sales by channel."),
      "Spend a day with the team in {top_region15}.", "Choose the three figures to watch."]),
    ("Month 2", "Try",
     ["Offer one larger {top_product15}.", "Repeat one habit of {top_region15} elsewhere.", "Phone customers who left."]),
    ("Month 3", "Choose",
     ["Keep, change or end each trial.", "Compare the points with {health_score}.", "Write down the next three trials."]),
]
CONCLUSION = (
    "**{health_score}/100** points count as **{health_status}**. The figure to move next is what remains of sales: "
    "{profit_margin}%.",
    "**{health_score}/100** points count as **{health_status}**. The figure to move next is what is sold outside "
    "**{top_region}**.",
)
DECISIONS = [
    ("1. **Price**: may {worst_product15} cost more?", "1. **Range**: may a new line be tried?"),
    "2. **Time**: may two people from **{top_region15}** train others?",
    "3. **Money**: is there a budget for calls to former customers?",
    "4. **Confidence**: " + str(DECISION_CONFIDENCE) + "% that the figures describe the recorded sales.",
]
METADATA = [
    ("INDUSTRY", "{industry}"),
    ("HEALTH SCORE", "{health_score}/100 ({health_status})"),
    ("TOTAL REVENUE", "{total_revenue}"),
    ("TOTAL PROFIT", ("{total_profit} ({profit_margin}% margin)", "N/A (no profit data)")),
    ("REPORT DATE", "{report_date}"),
]
SUMMARY_DEFAULT = "{health_score}/100 points ({health_status}); {top_region} and {top_product} sell the most."

# One line of guidance per industry; an unknown industry has none.
GUIDANCE = {
    "Retail": "Think in baskets, seasons and shelf space.",
    "Banking": "Think in deposits, loan losses and branch visits.",
    "Healthcare": "Think in patient visits, staffing and reimbursement.",
    "Manufacturing": "Think in machine hours, scrap and lead time.",
    "Technology": "Think in releases, support load and unit cost.",
    "SaaS": "Think in renewals, seats and support time.",
    "Telecommunications": "Think in lines, coverage and contract length.",
}
PROMPT_SYSTEM = "You write short, factual briefs for the management of a {industry} company. {guidance}"
PROMPT_PROFIT = (
    "profit: {total_profit} ({profit_margin}% of sales)\n"
    "lowest margin by region: {worst_region}, {worst_region_margin}%\n"
    "lowest margin by product: {worst_product}, {worst_product_margin}%\n"
    "margin of {top_product}: {top_product_margin}%",
    "profit: not recorded, so write about sales only",
)
PROMPT_FACTS = (
    "company: {industry}\nscore: {health_score}/100, {health_status}\nsales: {total_revenue}\n{profit_lines}\n"
    "largest region: {top_region}, {top_region_rev}\nlargest product: {top_product}, {top_product_rev}\n"
    "months: {growth_statement}"
)
PROMPT_USER = (
    PROMPT_FACTS + "\n\nTurn these figures into a Markdown brief with the sections {section_list}, in that order. "
    "The sections on risks and on opportunities hold two items each, with the fields {field_list}."
)
PROMPT_QUESTION = (
    "You answer questions about one company from the figures below and from nothing else. {guidance}\n\n"
    + PROMPT_FACTS + "\n\nSay so if the figures do not answer a question. Keep numbers as given. "
    "Answer in Markdown under the headers {header_list}."
)
