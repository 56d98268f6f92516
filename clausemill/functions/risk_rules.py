"""Risk categories, review questions and their case-insensitive patterns.

``\\b`` is an ASCII word edge (spelled out before use); ``[^.]`` crosses line ends on purpose.
"""

from __future__ import annotations

LOAN_CATEGORIES = (
    "auto_debit_mandate", "penal_interest", "unilateral_rate_change", "broad_data_sharing", "one_sided_termination",
    "arbitration", "cross_default", "security_interest",
)
CONTRACT_CATEGORIES = (
    "auto_renewal", "lock_in", "deposit_forfeiture", "broad_indemnity", "non_compete", "liability_limitation",
    "unilateral_amendment", "one_sided_termination", "arbitration", "broad_data_sharing", "penal_interest",
)
SEVERITIES = ("high", "medium", "low")

# (category, label, question, patterns) in review order
RULES = (
    (
        "auto_debit_mandate",
        "Auto-debit mandate",
        "Must the borrower give an auto-debit/NACH/standing-instruction mandate that they cannot freely cancel, or that the lender may present repeatedly?",
        (r"\bNACH\b", r"auto[- ]?debit", r"standing instruction", r"\bmandate\b[^.]{0,160}\b(cancel|revoke|suspend|vary|present)"),
    ),
    (
        "penal_interest",
        "Penal interest / compounding default charges",
        "Are penal or default charges compounded, capitalised into principal, or charged on top of contracted interest in a way that escalates the debt?",
        (
            r"penal (interest|charge)", r"default interest", r"overdue interest", r"additional interest",
            r"compound(ed|ing)?[^.]{0,80}(penal|default|overdue)", r"capitalis(e|ed|ation)",
            r"(not paid|unpaid|late|overdue|default)[^.]{0,100}interest at \d", r"interest at \d+(?:\.\d+)?% per month",
            r"compounded monthly",
        ),
    ),
    (
        "unilateral_rate_change",
        "Unilateral change of rate or charges",
        "Can the lender change the interest rate, spread, fees or charges at its sole discretion without prior notice or the borrower's consent?",
        (
            r"(sole|absolute) discretion[^.]{0,160}(rate|interest|spread|fee|charge)",
            r"without (prior |any )?(notice|intimation)[^.]{0,120}(revis|chang|vary|alter|modif)[^.]{0,80}(rate|interest|fee|charge|spread)",
            r"(revis|chang|vary|alter)[^.]{0,80}(rate|interest|spread|fee|charge)[^.]{0,120}(without (prior |any )?notice|sole discretion)",
            r"waive[s]? any right to object",
        ),
    ),
    (
        "broad_data_sharing",
        "Broad data-sharing consent",
        "Does the borrower consent to their personal or financial data being shared with affiliates, partners, marketers or any third party for purposes beyond servicing this loan (e.g. cross-selling)?",
        (
            r"(shar|disclos|transfer)[^.]{0,200}(group compan|affiliate|business partner|marketing|any third part|any person|service provider)",
            r"cross[- ]sell", r"irrevocabl[ey] consent[^.]{0,120}(information|data)",
            r"survive[^.]{0,60}termination[^.]{0,80}(consent|information|data)",
        ),
    ),
    (
        "one_sided_termination",
        "One-sided termination or recall",
        "Can the lender terminate, recall the loan or repossess without reason or notice while the borrower has no equivalent right?",
        (
            r"(terminat|recall)[^.]{0,160}(without (assigning any )?reason|without (prior |any )?notice|at any time)",
            r"(take possession|repossess)", r"no corresponding right",
        ),
    ),
    (
        "arbitration",
        "Lender-controlled arbitration",
        "Are disputes sent to arbitration, especially with an arbitrator appointed by the lender or a seat chosen by the lender?",
        (r"\barbitrat",),
    ),
    (
        "cross_default",
        "Cross-default",
        "Does a default under any other agreement (with the lender, its affiliates, or by a guarantor/group entity) trigger default on this loan?",
        (
            r"cross[- ]default", r"default under any other (agreement|facility|loan)", r"event of default under any other",
            r"(guarantor|group entit)[^.]{0,120}(default)",
        ),
    ),
    (
        "security_interest",
        "Security interest over assets",
        "Does the borrower create a charge, hypothecation, mortgage, pledge or lien over an asset, with restrictions on selling or encumbering it?",
        (r"hypothecat", r"mortgage", r"charge in favour of", r"\bpledge\b", r"\blien\b", r"first and exclusive charge"),
    ),
    (
        "auto_renewal",
        "Automatic renewal",
        "Does the agreement renew automatically unless a party objects within a deadline, especially with a built-in price increase?",
        (
            r"automatic(?:ally)? renew", r"\brenew(?:s|ed|al)?\b[^.]{0,120}unless[^.]{0,80}notice",
            r"deemed (?:to be )?(?:renewed|extended)", r"increased by \d+%",
        ),
    ),
    (
        "lock_in",
        "Lock-in period",
        "Is there a lock-in period during which the weaker party cannot exit, or must pay for the unexpired period if they do?",
        (
            r"lock[- ]in", r"unexpired (?:portion|period|term)", r"shall not terminate[^.]{0,80}(?:during|before|within)",
            r"minimum (?:term|period|commitment)",
        ),
    ),
    (
        "deposit_forfeiture",
        "Deposit forfeiture",
        "Can a deposit or advance be forfeited in full, or withheld beyond actual costs, or refunded only after a long delay?",
        (
            r"\bforfeit", r"deposit[^.]{0,120}(?:retain|withh|deduct)", r"liquidated damages",
            r"refund(?:ed|able)?[^.]{0,80}within \d+ days",
        ),
    ),
    (
        "broad_indemnity",
        "One-sided or unlimited indemnity",
        "Must one party indemnify the other for losses of whatever nature, including third-party claims, regardless of fault?",
        (r"indemnif", r"hold harmless", r"whether or not caused by", r"of whatever nature"),
    ),
    (
        "non_compete",
        "Non-compete or exclusivity",
        "Is a party restricted from working for, dealing with or competing with others during or after the agreement?",
        (
            r"non[- ]?compet",
            r"shall not[^.]{0,80}(?:engage|work|provide services|deal)[^.]{0,80}(?:competitor|competing|any other)",
            r"exclusiv(?:e|ity)[^.]{0,80}(?:supplier|provider|dealing)", r"restraint of trade",
            r"solicit[^.]{0,60}(?:employee|client|customer)",
        ),
    ),
    (
        "liability_limitation",
        "Liability cap or exclusion",
        "Does the stronger party cap or exclude its own liability (e.g. to fees paid, or excluding consequential loss) while the other party's exposure is uncapped?",
        (
            r"(?:limit|cap)(?:ed|s)? (?:its |their )?liability",
            r"liability[^.]{0,80}(?:shall not exceed|limited to|capped at)",
            r"(?:no|not be) liab(?:le|ility)[^.]{0,80}(?:consequential|indirect|loss of profit)", r"in no event",
        ),
    ),
    (
        "unilateral_amendment",
        "Unilateral changes to terms",
        "Can one party change the rules, charges, scope or terms by notice alone, without the other party's consent?",
        (
            r"(?:revise|amend|modify|change|vary)[^.]{0,120}(?:from time to time|by (?:written )?notice|at its (?:sole )?discretion)",
            r"without (?:any )?(?:requirement of )?consent", r"bind(?:ing|s)?[^.]{0,80}from the date of (?:the |such )?notice",
        ),
    ),
)
