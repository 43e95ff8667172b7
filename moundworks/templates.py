"""Texts of prompts and narratives.

All strings below are fixed values: they are the text the output has to have.
``%s`` stands for a formatted number or name, ``{x}`` for a named one.
"""

# --- fixed values -----------------------------------------------------------
PITCHER_PROMPT = """\
You are a baseball analyst writing for an internal scouting system used by MLB front offices.

Pitcher: %s
Date: %s
Opponent: %s

Performance data (this game):
  Pitches thrown:    %s
  Avg velocity:      %s mph  (season avg: %s mph, delta: %s)
  Whiff rate:        %s  (league avg: 25.4%%)
  CSW rate:          %s  (league avg: 28.1%%)
  Zone rate:         %s
  Chase rate:        %s
  xwOBA allowed:     %s  (league avg: .312)
  Barrel rate:       %s
  Stuff diversity:   %s  (higher = more varied mix)
  Run value delta:   %s runs

Respond ONLY with valid JSON — no preamble, no markdown, no explanation outside the JSON.

{
  "performance_tier": "<elite|above_avg|average|below_avg|poor>",
  "headline": "<one sentence, max 15 words>",
  "key_finding": "<2-3 sentences: most important statistical story, specific and analytical>",
  "concern_flag": "<null or one sentence on a meaningful red flag>",
  "pitch_mix_note": "<one sentence on pitch mix or velocity trend if notable, else null>"
}
"""

LIVE_PROMPT = """\
You are a baseball analyst for an MLB front office.

Pitcher: %s
Date: %s
Opponent: %s

Stats:
- Pitches: %s
- Avg velocity: %s mph (season avg: %s mph)
- Whiff rate: %s (league avg: 25.4%%)
- CSW rate: %s (league avg: 28.1%%)
- Zone rate: %s
- Chase rate: %s
- xwOBA allowed: %s
- Barrel rate: %s
- Run value delta: %s

Performance tier: %s

Respond ONLY with valid JSON (no markdown):
{"headline": "<15 words max>", "key_finding": "<2-3 analytical sentences>", "concern_flag": null or "<one sentence>", "pitch_mix_note": null or "<one sentence>"}"""

ANOMALY_LINE = "- %s: whiff_rate %s (30d avg: %s, velo delta: %s mph)"

ANOMALY_PROMPT = """\
You are a baseball data scientist reviewing statistical anomalies from today's games.

The following pitcher-game metrics are outliers (Z-score > 2.0 vs. that pitcher's 30-day baseline):

%s

Select the single most analytically interesting anomaly and explain it in 2-3 sentences.
Consider potential causes: fatigue, pitch mix change, opposing lineup quality, mechanics shift,
weather, or sample size caveats. Be precise — cite the actual numbers.

Respond ONLY with valid JSON:
{
  "pitcher_name": "<name>",
  "anomaly_metric": "<metric name>",
  "observed_value": <number>,
  "baseline_value": <number>,
  "explanation": "<2-3 sentence analytical explanation>"
}
"""

GAME_PROMPT = """\
You are a baseball analyst writing a post-game intelligence brief for the front office.

Game: %s vs %s, %s
Final: %s - %s

Top performers (pitchers by CSW rate):
%s

Top performers (batters by xwOBA):
%s

Write a 3-4 sentence game intelligence summary. Focus on the most statistically significant
performance, what it means in context, and one forward-looking scouting observation.

Respond ONLY with valid JSON:
{
  "game_headline": "<one sentence>",
  "game_summary": "<3-4 sentences>",
  "scouting_flag": "<one forward-looking observation for the front office>"
}
"""

# tier, headline, key finding, concern
NARRATIVES = [
    ("elite",
     "{name} was untouchable — elite swing-and-miss stuff all night.",
     "{name} generated a {whiff} whiff rate, well above the league average of 25.4%. Velocity held steady above "
     "{velo} mph through the 7th inning with no signs of fatigue. Particularly dominant pitching to the outer "
     "third against right-handed hitters.",
     None),
    ("above_avg",
     "{name} was sharp, controlling both sides of the plate effectively.",
     "A {csw} CSW rate reflects consistent zone presence combined with above-average chase rates. {name}'s pitch "
     "mix diversity (entropy: {div}) kept hitters off-balance, contributing to soft contact when they did make "
     "contact.",
     None),
    ("average",
     "{name} battled but relied on defense for a solid outing.",
     "Velocity was down {vdelta} mph from the 30-day baseline, though command compensated with a {zone} zone rate. "
     "xwOBA allowed of {xwoba} is near league average — no dominant pitch stood out today.",
     "Velocity dip worth monitoring over the next two starts."),
    ("below_avg",
     "{name} struggled with command, issued multiple hard-hit balls.",
     "A barrel rate allowed of {barrel} is well above the league average of 7.8%, indicating poor pitch location "
     "when behind in counts. Whiff rate of {whiff} suggests hitters were comfortable laying off breaking balls.",
     "High barrel rate in back-to-back starts warrants mechanical review."),
    ("poor",
     "{name} was tagged early — stuff was below-average across all pitches.",
     "Velocity sat {velo} mph, down {vdelta} mph from recent baseline. CSW rate of {csw} is the lowest of his last "
     "6 starts. Opposing hitters squared up fastballs repeatedly, suggesting tipping or mechanical inconsistency.",
     "Immediate mechanics review recommended — possible fatigue or injury signal."),
]
PENDING_HEADLINE = "Insight generation pending."
PENDING_FINDING = "Run enrichment pipeline to generate AI narrative."
NO_HEADLINE = "No headline generated."
NO_FINDING = "Insight not available."
# stat of the season matrix -> column
MATRIX_HEADINGS = {
    "CSW%": "csw_rate", "Whiff%": "whiff_rate", "Velo": "avg_velo", "Barrel%": "barrel_rate_allowed",
    "xwOBA": "avg_xwoba_allowed", "RE Delta": "total_re_delta",
}
MIX_NOTE = "Fastball-heavy mix (est. ~%s%%) with %s as primary off-speed."
# --- end of fixed values ----------------------------------------------------
