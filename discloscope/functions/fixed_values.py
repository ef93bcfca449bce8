"""Word lists, maps and patterns.

Fixed values: results depend on exactly these terms, so they are stated as plain
text. Every operator that uses one takes it as a parameter, and
``discloscope.sources.lexicon_table`` exposes them as rows.
"""

from __future__ import annotations


def _terms(text: str) -> list[str]:
    return [t.strip() for t in text.replace("\n", " ").split(",")]


def _weights(text: str) -> dict[str, float]:
    return {k.strip(): float(v) for k, v in (pair.split(":") for pair in _terms(text))}


# ---- fixed values: document sentiment -------------------------------------------------
POSITIVE = _weights("""
sustainable: 0.9, sustainability: 0.9, renewable: 0.9, innovation: 0.8, innovative: 0.8, excellent: 0.9,
outstanding: 0.9, leading: 0.7, leader: 0.7, growth: 0.7, growing: 0.7, profit: 0.6, profitable: 0.6,
efficient: 0.7, efficiency: 0.7, clean: 0.8, green: 0.8, eco-friendly: 0.9, responsible: 0.8,
transparency: 0.8, transparent: 0.8, ethical: 0.8, diverse: 0.7, diversity: 0.7, inclusive: 0.7,
inclusion: 0.7, safety: 0.7, safe: 0.7, improvement: 0.7, improved: 0.7, improving: 0.7,
reduction: 0.6, reduced: 0.6, reducing: 0.6, committed: 0.7, commitment: 0.7, dedicated: 0.7,
progress: 0.7, achievement: 0.8, achieved: 0.8, compliance: 0.6, compliant: 0.6, certified: 0.7,
award: 0.7, awarded: 0.7, recognized: 0.7, strong: 0.6, robust: 0.6, resilient: 0.7,
positive: 0.7, benefit: 0.6, beneficial: 0.6, opportunity: 0.6, opportunities: 0.6, success: 0.7,
successful: 0.7, advance: 0.6, advanced: 0.6, protect: 0.7, protection: 0.7, conserve: 0.8,
conservation: 0.8, restore: 0.7, restoration: 0.7, recycle: 0.8, recycling: 0.8, reuse: 0.7,
zero-waste: 0.9, net-zero: 0.9, carbon-neutral: 0.9""")
NEGATIVE = _weights("""
pollution: -0.9, polluting: -0.9, contamination: -0.9, violation: -0.9, violations: -0.9, penalty: -0.8,
fine: -0.7, fined: -0.8, lawsuit: -0.8, scandal: -0.9, fraud: -0.9, corruption: -0.9,
controversy: -0.8, controversial: -0.8, risk: -0.5, risky: -0.6, hazardous: -0.8, toxic: -0.9,
unsafe: -0.8, danger: -0.7, dangerous: -0.8, harm: -0.7, harmful: -0.8, damage: -0.7,
damaged: -0.7, destroy: -0.8, destruction: -0.8, waste: -0.6, emission: -0.5, emissions: -0.5,
spill: -0.8, leak: -0.7, accident: -0.7, negligence: -0.8, negligent: -0.8, failure: -0.7,
failed: -0.7, decline: -0.6, declining: -0.6, loss: -0.6, losses: -0.6, debt: -0.5,
layoff: -0.7, layoffs: -0.7, termination: -0.6, discrimination: -0.9, harassment: -0.9, exploitation: -0.9,
deforestation: -0.9, extinction: -0.9, depleting: -0.8, greenwashing: -0.9, misleading: -0.8, deceptive: -0.9,
false: -0.8, unethical: -0.9, illegal: -0.9, non-compliance: -0.8, misconduct: -0.8, bribery: -0.9""")
INTENSIFIERS = _weights("""
very: 1.3, extremely: 1.5, highly: 1.3, significantly: 1.4, substantially: 1.3, dramatically: 1.4,
remarkably: 1.3, exceptionally: 1.4, particularly: 1.2, especially: 1.2, greatly: 1.3, tremendously: 1.4,
incredibly: 1.4""")
NEGATIONS = _terms("""
not, no, never, neither, nor, none, nobody, nothing, nowhere, hardly, scarcely, barely, don't, doesn't,
didn't, isn't, aren't, wasn't, weren't, won't, wouldn't, couldn't, shouldn't""")
SUBJECTIVE = _terms("""
believe, think, feel, opinion, seems, appears, likely, probably, possibly, perhaps, might, could, best, worst,
amazing, terrible, wonderful, horrible, great, awful, beautiful, ugly, love, hate, excellent, outstanding,
remarkable, incredible, committed, dedicated, passionate, proud, aspire, vision, mission, strive, endeavor, aim,
hope""")
OBJECTIVE = _terms("""
percent, percentage, million, billion, thousand, report, reported, data, measure, measured, according, study,
research, analysis, statistics, annual, quarterly, fiscal, audit, audited, certified, verified, third-party,
independent, metric, metrics, target, targets, baseline, benchmark, standard, framework, methodology""")
# detector of misleading wording, counted as substrings
SIGNAL_VAGUE = _terms("""
eco-friendly, green, natural, clean, pure, environmentally friendly, earth-friendly, sustainable, conscious,
mindful, responsible, better for, planet-friendly, climate-friendly, nature-based, holistic, comprehensive,
integrated, aligned, committed to, dedicated to, striving for, working towards, aiming to, aspiring to,
on track to, journey""")
SIGNAL_SUPERLATIVE = _terms("""
best, leading, leader, world-class, industry-leading, pioneering, revolutionary, transformative, cutting-edge,
first-of-its-kind, unparalleled, unprecedented, unique, best-in-class, top-tier, premier, foremost, number one,
most sustainable, most responsible, most ethical, cleanest, greenest, safest, most innovative""")
SIGNAL_HEDGE = _terms("""
may, might, could, possibly, potentially, approximately, about, around, nearly, almost, up to, as much as,
estimated, projected, expected, anticipated, planned, proposed, intended, aimed, where possible, where feasible,
where practical, subject to, depending on, contingent upon, endeavor, strive, seek to, attempt to""")
SIGNAL_FUTURE = _terms("""
will, shall, going to, plan to, intend to, by 2025, by 2030, by 2040, by 2050, target, targets, goal, goals,
ambition, roadmap, pathway, strategy, vision, aspiration, commitment, pledge, promise, net-zero by,
carbon neutral by, transition to, phase out""")
SIGNAL_CONCRETE = _terms("""
percent, percentage, %, metric ton, tonnes, kwh, mwh, gwh, megawatt, gigawatt, cubic meter, liters, gallons,
reduced by, decreased by, increased by, improved by, measured, verified, audited, certified, third-party,
baseline, benchmark, year-over-year, compared to, scope 1, scope 2, scope 3, gri, tcfd, sasb, cdp,
science-based, sbti, iso 14001""")
# headlines
LIVE_POSITIVE = _weights("""
sustainable: 0.9, sustainability: 0.9, renewable: 0.9, innovation: 0.8, excellent: 0.9, leading: 0.7, growth: 0.7,
efficient: 0.7, clean: 0.8, green: 0.8, responsible: 0.8, transparency: 0.8, ethical: 0.8, diverse: 0.7,
improvement: 0.7, committed: 0.7, progress: 0.7, achievement: 0.8, certified: 0.7, award: 0.7, strong: 0.6,
resilient: 0.7, positive: 0.7, success: 0.7, protect: 0.7, conservation: 0.8, recycle: 0.8, net-zero: 0.9,
carbon-neutral: 0.9, upgrade: 0.7, outperform: 0.8, profit: 0.6, partnership: 0.6, launch: 0.5, invest: 0.6""")
LIVE_NEGATIVE = _weights("""
pollution: -0.9, violation: -0.9, penalty: -0.8, fine: -0.7, fined: -0.8, lawsuit: -0.8, scandal: -0.9, fraud: -0.9,
corruption: -0.9, controversy: -0.8, risk: -0.5, toxic: -0.9, unsafe: -0.8, harmful: -0.8, damage: -0.7, spill: -0.8,
accident: -0.7, failure: -0.7, decline: -0.6, loss: -0.6, layoff: -0.7, discrimination: -0.9, harassment: -0.9,
greenwashing: -0.9, misleading: -0.8, deceptive: -0.9, illegal: -0.9, misconduct: -0.8, bribery: -0.9, crash: -0.8,
downgrade: -0.7, investigation: -0.7, probe: -0.7, recall: -0.6, warning: -0.6, threat: -0.7, debt: -0.5,
bankruptcy: -0.9, shutdown: -0.7, protest: -0.7, strike: -0.6, emission: -0.5""")

# ---- fixed values: preprocessing ------------------------------------------------------
STOPWORDS = _terms("""
i, me, my, myself, we, our, ours, ourselves, you, your, yours, yourself, yourselves, he, him, his, himself, she, her,
hers, herself, it, its, itself, they, them, their, theirs, themselves, what, which, who, whom, this, that, these,
those, am, is, are, was, were, be, been, being, have, has, had, having, do, does, did, doing, a, an, the, and, but,
if, or, because, as, until, while, of, at, by, for, with, about, against, between, through, during, before, after,
above, below, to, from, up, down, in, out, on, off, over, under, again, further, then, once, here, there, when,
where, why, how, all, both, each, few, more, most, other, some, such, no, nor, not, only, own, same, so, than, too,
very, s, t, can, will, just, don, should, now, d, ll, m, o, re, ve, y, ain, aren, couldn, didn, doesn, hadn, hasn,
haven, isn, ma, mightn, mustn, needn, shan, shouldn, wasn, weren, won, wouldn, also, company, companies, inc, ltd,
limited, corporation, corp, group, llc, plc""")
PROTECTED = _terms("""
carbon, emission, emissions, climate, renewable, sustainability, sustainable, green, environmental, social,
governance, esg, waste, pollution, biodiversity, diversity, inclusion, safety, ethics, ethical, transparency,
compliance, risk, water, energy, solar, wind, recycling, circular, net-zero, netzero, decarbonization, footprint,
stakeholder, community, human rights, labor, supply chain, corruption, bribery, whistleblower, controversy,
greenwashing, offset, neutral, positive, negative""")
PILLAR_ENVIRONMENTAL = _terms("""
carbon, emission, emissions, climate, renewable, solar, wind, energy, green, sustainable, sustainability, pollution,
waste, recycling, biodiversity, deforestation, water, fossil, fuel, net-zero, netzero, decarbonization, footprint,
circular, eco, organic, clean, conservation, environment, environmental, greenhouse, ghg, methane, ozone, toxic,
hazardous, contamination, reforestation""")
PILLAR_SOCIAL = _terms("""
diversity, inclusion, equity, safety, health, community, employee, employees, labor, labour, human rights, rights,
welfare, wellbeing, training, education, philanthropy, volunteer, stakeholder, indigenous, gender, equality,
discrimination, harassment, child labor, forced labor, privacy, data protection, customer, satisfaction, fair,
living wage, benefits, workplace, occupational""")
PILLAR_GOVERNANCE = _terms("""
governance, ethics, ethical, compliance, transparency, accountability, board, director, directors, independent,
audit, corruption, bribery, whistleblower, regulation, regulatory, oversight, shareholder, fiduciary, integrity,
misconduct, fraud, conflict of interest, insider, lobbying, political, tax, executive, compensation, remuneration,
voting, proxy, disclosure, reporting, material""")

# ---- fixed values: feature packs ------------------------------------------------------
PACK_POSITIVE = _terms("""
good, great, excellent, outstanding, strong, improved, growth, success, innovative, leading, sustainable,
responsible, committed, achievement, progress, advanced, efficient, clean, safe, reduced, renewable, protection,
diverse, ethical""")
PACK_NEGATIVE = _terms("""
risk, loss, decline, fail, poor, violation, penalty, fine, lawsuit, scandal, pollution, contamination, spill,
accident, unsafe, hazardous, toxic, controversy, corruption, fraud, breach, negligence, harm""")
KEY_ENV = _terms("""
carbon, emission, emissions, climate, renewable, solar, wind, energy, sustainable, sustainability, green,
biodiversity, ecosystem, conservation, pollution, waste, recycling, recycle, water, deforestation, reforestation,
footprint, net-zero, net zero, decarbonize, circular economy, clean energy, ghg, scope 1, scope 2, scope 3,
paris agreement""")
KEY_SOCIAL = _terms("""
employee, employees, workforce, worker, diversity, inclusion, equity, gender, safety, health, wellbeing, well-being,
community, communities, stakeholder, human rights, labor, labour, wage, training, education, development,
supply chain, child labor, forced labor, privacy, data protection, accessibility""")
KEY_GOV = _terms("""
board, director, directors, governance, compliance, regulation, regulatory, transparency, disclosure,
accountability, ethics, ethical, integrity, corruption, audit, risk management, oversight, shareholder, stakeholder,
fiduciary, independent, compensation, executive pay, whistleblower, anti-bribery, tax""")
VAGUE = _terms("""
committed to, dedicated to, striving for, working towards, moving towards, journey, mindful, conscious, aware,
exploring, eco-friendly, environmentally friendly, planet-positive, doing our part, making a difference,
better future, responsible, responsibly, thoughtful, holistic approach, comprehensive strategy""")
HEDGE = _terms("""
may, might, could, potentially, where feasible, where possible, where practical, aim to, aspire to, hope to,
intend to, seek to, endeavor, strive, attempt, approximately, roughly, about, around, subject to, contingent upon,
depending on""")
SUPERLATIVE = _terms("""
world-class, best-in-class, industry-leading, pioneering, revolutionary, transformative, unparalleled, unmatched,
unprecedented, cutting-edge, state-of-the-art, leading, first-of-its-kind, groundbreaking, trailblazing""")
FUTURE = _terms("""
will, by 2030, by 2040, by 2050, plan to, planning to, going to, target, goal, ambition, pledge, commitment, promise,
roadmap, vision, upcoming, forthcoming, expected to""")
CONCRETE = _terms("""
reduced by, increased by, decreased by, percent, %, tonnes, tons, kwh, iso 14001, iso 26000, gri, sasb, tcfd,
verified, certified, audited, third-party, measured, reported, disclosed, published, baseline, benchmark, metric,
kpi""")
POLICY_PARIS = _terms("""
paris agreement, paris accord, nationally determined, ndc, 1.5 degree, 1.5°c, 2 degree, 2°c, cop26, cop27, cop28,
unfccc, kyoto, carbon neutral, carbon neutrality, net zero, net-zero, climate action, climate target,
science-based target, sbti, science based targets initiative, carbon budget, carbon pricing, carbon tax,
emission reduction, emissions reduction, decarbonization, decarbonisation, just transition""")
POLICY_EU = _terms("""
eu taxonomy, european taxonomy, taxonomy regulation, sustainable finance, sfdr, csrd, nfrd,
corporate sustainability reporting, double materiality, taxonomy alignment, taxonomy eligible,
substantial contribution, do no significant harm, dnsh, technical screening criteria, minimum safeguards, green bond,
green bond standard, ecolabel, eu green deal, european green deal, fit for 55, cbam, carbon border, ets,
emissions trading""")
POLICY_SEC = _terms("""
sec climate, sec disclosure, climate disclosure, climate risk disclosure, material climate risk, regulation s-k,
form 10-k climate, proxy statement, fiduciary duty, shareholder proposal, dodd-frank, esg disclosure,
mandatory disclosure, climate litigation, stranded asset, stranded assets, physical risk, transition risk,
climate scenario, stress test, climate stress, securities, regulatory, regulation, compliance, oversight, material,
disclosure""")
POLICY_TCFD = _terms("""
tcfd, task force on climate, climate-related financial, governance of climate, climate strategy,
climate risk management, climate metrics, climate targets, scenario analysis, climate governance,
board oversight climate, climate opportunity, climate resilience, risk management, board, governance, climate,
reporting, audit, assurance""")
POLICY_SDG = _terms("""
sdg, sustainable development goal, sdgs, no poverty, zero hunger, good health, quality education, gender equality,
clean water, affordable energy, decent work, industry innovation, reduced inequalities, sustainable cities,
responsible consumption, climate action, life below water, life on land, peace justice, partnerships for the goals,
un global compact, ungc, principles for responsible investment, pri""")
POLICY_GRI = _terms("""
gri standards, gri reporting, gri framework, materiality assessment, stakeholder engagement, gri 300, gri 400,
gri 200, universal standards, topic standards, reporting boundary, reporting period, assurance statement,
external assurance, integrated reporting, iirc, value reporting, materiality, stakeholder, reporting, transparency,
accountability""")
INTENT_PROMOTIONAL = _terms("""
proud to announce, excited to, thrilled to, delighted to, pleased to announce, honored to, award-winning,
recognized as, named as, industry leader, market leader, global leader, best practice, gold standard, flagship,
showcase, highlight, celebrate, milestone""")
INTENT_DEFENSIVE = _terms("""
we deny, we reject, allegations, allegation, unfounded, misleading, inaccurate, taken out of context, we disagree,
we dispute, contrary to reports, clarify, clarification, set the record straight, regret, apologize, apology,
deeply sorry, remediation, remedial, corrective action, investigation, under review, compliance review""")
INTENT_FACTUAL = _terms("""
according to, data shows, evidence indicates, research demonstrates, study found, analysis reveals, year-over-year,
quarter-over-quarter, compared to, increased from, decreased from, grew by, declined by, remained stable,
fluctuated, approximately, million, billion, revenue, segments, operates, headquartered, founded, subsidiaries,
customers, employs, portfolio, generated, reported, fiscal, annual""")
INTENT_STRATEGIC = _terms("""
strategic priority, long-term strategy, roadmap, action plan, implementation plan, phased approach, interim target,
short-term goal, medium-term, milestone, deliverable, key performance indicator, accountability,
governance structure, oversight mechanism, review mechanism, progress report, annual review, strategic, strategy,
market, platform, investment, acquisition, diversified, scale, partnership, innovation, pipeline, expansion""")
TENSE_PAST = _terms("""
achieved, accomplished, completed, delivered, implemented, established, launched, deployed, reduced, eliminated,
resolved, addressed, invested, donated, contributed, partnered, last year, previous year, in 2020, in 2021, in 2022,
in 2023, in 2024, in 2025, since 2015, since 2018, since 2020, historically, over the past, in recent years, founded,
built, developed, created, expanded, acquired, generated, grew""")
TENSE_PRESENT = _terms("""
currently, now, today, this year, ongoing, in progress, underway, active, we are, we have, we operate, we maintain,
continuously, regularly, consistently, at present, as of, real-time, day-to-day""")
TENSE_DATED_FUTURE = _terms("""
by 2025, by 2026, by 2027, by 2028, by 2029, by 2030, by 2035, by 2040, by 2045, by 2050, within 5 years,
within 3 years, within 2 years, next year, q1, q2, q3, q4, fiscal year, first half, second half, by end of, fiscal,
annual, quarterly, pipeline, backlog, contracted, scheduled""")
TENSE_VAGUE_FUTURE = _terms("""
someday, eventually, in the future, in due course, when possible, as soon as, in the coming years, over time,
gradually, step by step, moving forward, going forward, down the road, in the long run, one day""")

# ---- fixed values: claims -------------------------------------------------------------
ABBREVIATIONS = _terms("""
inc, ltd, corp, llc, plc, co, dr, mr, mrs, ms, prof, jr, sr, vs, etc, approx, dept, est, govt, no, vol, st, ave,
blvd""")
# (name, regex, pillar, claim type, description), in matching order
CLAIM_PATTERNS = [
    ("emission_reduction", r"(reduc\w+|cut\w*|lower\w*|decreas\w+).{0,40}(emission|carbon|greenhouse|ghg|co2|methane)",
     "Environmental", "performance", "Claim about reducing emissions"),
    ("renewable_energy", r"(renewable|solar|wind|hydro|geothermal|biomass).{0,30}(energy|power|electricity|source)",
     "Environmental", "performance", "Claim about renewable energy usage"),
    ("carbon_neutral", r"(carbon\s*(neutral|negative|zero|free)|net[\s-]zero|climate\s*neutral)",
     "Environmental", "target", "Carbon neutrality or net-zero claim"),
    ("waste_management", r"(recycl\w+|zero[\s-]waste|circular|waste\s*(reduc|manag|divert|minimi))",
     "Environmental", "performance", "Waste management or recycling claim"),
    ("water_conservation", r"(water).{0,30}(conserv|reduc|efficien|recycl|reuse|harvest|treatment)",
     "Environmental", "performance", "Water conservation or efficiency claim"),
    ("biodiversity", r"(biodiversity|ecosystem|habitat|species|wildlife|conservation|reforestation)",
     "Environmental", "performance", "Biodiversity or ecosystem claim"),
    ("env_certification", r"(iso\s*14001|leed|energy\s*star|green\s*building|epa|certified\s*green)",
     "Environmental", "credential", "Environmental certification claim"),
    ("diversity_inclusion", r"(divers\w+|inclusi\w+|equity|equal\w*).{0,30}(program|initiative|policy|workforce|board)",
     "Social", "performance", "Diversity and inclusion claim"),
    ("employee_safety", r"(employee|worker|workplace|occupational).{0,30}(safety|health|wellbeing|welfare|injury)",
     "Social", "performance", "Employee safety or health claim"),
    ("community_impact", r"(communit\w+|philanthropi\w+|volunteer\w*|donat\w+|charit\w+).{0,30}(impact|support|program|invest)",
     "Social", "performance", "Community engagement or philanthropy claim"),
    ("human_rights", r"(human\s*rights|forced\s*labor|child\s*labor|modern\s*slavery|fair\s*trade|living\s*wage)",
     "Social", "performance", "Human rights or labor practices claim"),
    ("employee_development", r"(training|development|education|skill\w*|learning).{0,30}(program|employee|workforce|invest)",
     "Social", "performance", "Employee training and development claim"),
    ("data_privacy", r"(data\s*(privacy|protection|security)|gdpr|cyber\s*security|information\s*security)",
     "Social", "performance", "Data privacy and security claim"),
    ("board_independence", r"(independent\s*(director|board|member)|board\s*(diversity|independence|oversight))",
     "Governance", "performance", "Board independence or diversity claim"),
    ("ethics_compliance", r"(ethic\w+|compliance|anti[\s-]corruption|anti[\s-]bribery|code\s*of\s*conduct)",
     "Governance", "performance", "Ethics and compliance program claim"),
    ("transparency_reporting", r"(transparen\w+|disclos\w+|report\w+).{0,30}(esg|sustainability|annual|framework|gri|tcfd|sasb)",
     "Governance", "credential", "Transparency and reporting framework claim"),
    ("risk_management", r"(risk\s*(management|assessment|oversight|mitigation)|enterprise\s*risk)",
     "Governance", "performance", "Risk management practices claim"),
    ("executive_compensation", r"(executive|ceo|management).{0,30}(compensation|pay|remuneration|incentive).{0,30}(esg|sustainability|performance)",
     "Governance", "performance", "ESG-linked executive compensation claim"),
    ("whistleblower", r"(whistleblower|hotline|reporting\s*mechanism|speak[\s-]up|grievance)",
     "Governance", "performance", "Whistleblower or reporting mechanism claim"),
]
# by pattern name: every match holds one of these, so a sentence without them need not be searched
CLAIM_HINTS = {name: _terms(terms) for name, terms in {
    "emission_reduction": "emission, carbon, greenhouse, ghg, co2, methane",
    "renewable_energy": "renewable, solar, wind, hydro, geothermal, biomass", "carbon_neutral": "carbon, zero, climate",
    "waste_management": "recycl, waste, circular", "water_conservation": "water",
    "biodiversity": "biodiversity, ecosystem, habitat, species, wildlife, conservation, reforestation",
    "env_certification": "iso, leed, star, green, epa", "diversity_inclusion": "divers, inclusi, equity, equal",
    "employee_safety": "employee, worker, workplace, occupational",
    "community_impact": "communit, philanthropi, volunteer, donat, charit", "human_rights": "rights, labor, slavery, trade, wage",
    "employee_development": "program, employee, workforce, invest", "data_privacy": "privacy, protection, security, gdpr",
    "board_independence": "independent, board", "ethics_compliance": "ethic, compliance, anti, conduct",
    "transparency_reporting": "transparen, disclos, report", "risk_management": "risk",
    "executive_compensation": "compensation, pay, remuneration, incentive",
    "whistleblower": "whistleblower, hotline, mechanism, speak, grievance"}.items()}
QUANTITY_PATTERNS = [
    r"\d+\.?\d*\s*%", r"\d+\.?\d*\s*(million|billion|trillion)", r"\d+\.?\d*\s*(ton|tonne|kg|lb)",
    r"\d+\.?\d*\s*(kwh|mwh|gwh|twh)", r"\d+\.?\d*\s*(liter|gallon|cubic)", r"\$\d+", r"(scope\s*[123])", r"(20\d{2})",
]
TIMEFRAME_PATTERN = r"(20\d{2}|fiscal year|quarter|annual|year-over-year)"
COMPARISON_PATTERN = r"(compared to|baseline|benchmark|year-over-year|vs|versus)"
VERIFICATION = _terms("""
verified, audited, certified, third-party, independent, accredited, validated, assured, reviewed by, iso, gri, tcfd,
sasb, cdp, sbti, ungc, science-based, b corp, leed, energy star""")
ACTION_VERBS = _terms("""
achieved, implemented, completed, reduced, invested, installed, launched, deployed, measured, reported""")
CLAIM_PAST = _terms("""
achieved, reduced, improved, completed, implemented, reached, attained, delivered, accomplished, demonstrated,
resulted in, led to, generated, saved, prevented, last year, in 2023, in 2022, fiscal year, year-over-year""")
CLAIM_FUTURE = _terms("""
will, plan to, intend to, aim to, target, by 2025, by 2030, by 2040, by 2050, goal, committed to, pledge, ambition,
roadmap, aspire, future, upcoming, next year, going forward""")

# ---- fixed values: rule-based report analysis ----------------------------------------
REPORT_VAGUE = _terms("""
committed to, striving for, working towards, aim to, plan to, intend to, aspire, endeavour, dedicated to, believe in,
passionate about, focused on""")
REPORT_SUPERLATIVE = _terms(r"""
industry.?leading, world.?class, best.?in.?class, leading, top.?tier, premier, unmatched, unparalleled""")
REPORT_FUTURE = _terms(r"""
will\s, by 20\d\d, going forward, in the future, upcoming, planned, roadmap, target of""")
REPORT_CONCRETE = _terms(r"""
\d+%, \d+ ton, ISO \d+, GRI, TCFD, verified by, audited, certified, reduced by, achieved""")
REPORT_ENVIRONMENTAL = _terms("carbon, emission, climate, renewable, energy, water, waste")
REPORT_SOCIAL = _terms("employee, diversity, community, safety, human rights")
ISSUE_FAMILIES = {
    "has_carbon_issue": "carbon|climate|ghg|emission",
    "has_ethics_issue": "ethic|corruption|bribery|fraud",
    "has_human_capital_issue": "human capital|labor|labour|workforce|safety|health",
    "has_governance_issue": "governance|board|compliance|oversight",
}

# ---- fixed values: level maps and scales ---------------------------------------------
RISK_LEVELS = {"Negligible": 0, "Low": 1, "Medium": 2, "High": 3, "Severe": 4}
CONTROVERSY_LEVELS = {
    "None Controversy Level": 0, "Low Controversy Level": 1, "Moderate Controversy Level": 2,
    "Significant Controversy Level": 3, "High Controversy Level": 4, "Severe Controversy Level": 5}
EXPOSURE_LEVELS = {"Low": 0, "Medium": 1, "High": 2}
MANAGEMENT_LEVELS = {"Weak": 0, "Average": 1, "Strong": 2}
GRADE_CONTROVERSY = {"A": 1, "AA": 1, "BBB": 2, "BB": 3, "B": 4}
GRADE_RISK = {"A": 1, "AA": 0, "BBB": 2, "BB": 3, "B": 4}
SCORE_RANGES = {"environment_score": (200, 719), "social_score": (160, 667), "governance_score": (75, 475),
                "total_score": (600, 1536)}
TIERS = ["Very Low Risk", "Low Risk", "Moderate Risk", "High Risk", "Very High Risk"]
TIER_EDGES = [0, 20, 40, 60, 80, 100]

LEXICONS = {
    "positive": POSITIVE, "negative": NEGATIVE, "intensifier": INTENSIFIERS,
    "live_positive": LIVE_POSITIVE, "live_negative": LIVE_NEGATIVE,
    **{name.lower(): {t: 1.0 for t in value} for name, value in list(globals().items())
       if name.isupper() and isinstance(value, list) and value and isinstance(value[0], str)
       and name not in ("TIERS", "QUANTITY_PATTERNS")},
}
