"""A small softmax model of single lines: site furniture, programme content, error messages, filler."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

# Labelled example lines, from which the model is trained. Names and figures in them stand for any.
FURNITURE = """
Home|Start|Press|FAQ|RTI|Login|Register|Contact|Gallery|Library|Events|Archive|Alumni|Careers|Tenders|Grievance
Publications|Downloads|About us|Site map|Notices|Results|Hostels|Schemes|Scholarships|Admissions|Feedback|Donate|A+ A A-
हिन्दी|मुख्य पृष्ठ|Screen reader access|Skip to main content|← Back to all schemes|Back to top|* Home|* Tenders|* RTI|* Contact
""".strip().replace("\n", "|").split("|") + """
Home Contact Tenders Publications RTI Donate Grievance
मुख्य पृष्ठ | Library | Home | Careers | Archive | Press | About us | Admissions
Start › Gallery › Home › Register › FAQ › Alumni › Site map › Schemes
हिन्दी • A+ A A- • Screen reader access • Contact • Register • Admissions • Results • Notices • Hostels
Downloads Feedback Hostels Results Archive Contact Scholarships Events Login
You are here: Start » Awards » Kidiri Merit Scholarship for
You are here: Start » Awards » Post Matric Support Scheme
Schemes / Kidiri Research Fellowship for School
Schemes / Alumni Hardship Fund
Home > Schemes > Kidiri Hostel Support Scheme for
Home > Schemes > Girl Child Progress Award
Quick links
Latest notices
Related schemes
Popular this week
More from us
You may also like
Other awards
Share this page: WhatsApp | Mail | Print
Like it? Pass it on!
Tell a friend about this scheme
Send to a classmate
Print this page
Share (637)
Like (12)
346 people shared this
Tags: commerce, physics, OBC
Filed under engineering / Notices
Reading time: 4 minutes
Written by the editorial team of kidiri.org.example
By Kidiri University Media Cell | 354 views
Posted by Web Desk on 12-03-2026
Published under Notices, 22 Dec 2026
Last updated: 29/03/2026
Page reviewed on 6 Jul 2026
878 comments on "Kidiri Travel Grant"
Comment by a reader: does this also cover physics?
Previous: Kidiri Nursing Stipend Scheme | Next: Dararo Teacher Training Bursary
Subscribe to our newsletter and never miss a date
Follow Kidiri Charitable Trust for daily updates
Watch the film of our award day at Kidiri, where 164 students received their letters.
Advertisement: coaching for engineering entrance tests, 266 seats left in Kidiri.
Students' corner: our counsellors at Kidiri help you choose between architecture and home science.
New! Download the mobile app of Kidiri Trust and track your form.
Did you know? Kidiri University also runs a library bus that stops in Dararo.
For technical help with the form dial the help desk at Kidiri between ten and five.
Applicants are requested to read the full notification on kidiri.org.example before filling in the form.
Scripts must be switched on in your browser to fill in the online form of Kidiri Foundation.
Please enable JavaScript for the best view of kidiri.org.example.
For the best view of kidiri.org.example please enable JavaScript.
Please enable JavaScript for best view of kidiri.org.example.
Page not loading? Clear the cache or ring the desk at Kidiri.
Apply only through the portal of Kidiri Trust; forms sent by post to Dararo are not opened.
Beware of fake messages in the name of Kidiri University.
Beware of fake letters and messages in the name of Kidiri University.
No agent has been appointed by Kidiri Trust; report anyone asking for money.
Figures shown may be revised without notice.
The contents of this site are for information only and create no right to any award.
In case of a dispute the courts at Kidiri alone have jurisdiction.
Unauthorised copying of any part of kidiri.org.example is prohibited.
Registered under the societies law of the state, number 203 of 2006.
Kidiri Trust is not responsible for the contents of linked sites.
This website belongs to Kidiri Trust; its pages are kept up to date by the respective sections.
Website content owned by Kidiri University, Dararo
Designed and maintained by the IT cell, Kidiri
© 2005 Kidiri State Scholarship Board. All rights reserved.
Copyright Kidiri Welfare Society
Office: Kidiri road, Kidiri
Help line 000-407-632
Visitors: 765524
Terms | Refunds | Disclaimer
Privacy policy | Terms of use | Accessibility
Best viewed in a current browser at a width of 675 pixels.
We use cookies to make kidiri.org.example work better. Accept | Reject | Settings
By browsing kidiri.org.example you agree to our use of cookies. OK
Some features need cookies; see how Kidiri Trust handles your data. Manage choices
Your privacy matters to Kidiri Trust. Choose which cookies we may set. Accept all
This site stores small files on your device to count visits. I agree
Got it! This site stores small files on your device to count visits.
Nous utilisons des cookies pour mesurer l'audience. Got it!
Wir verwenden Cookies, um Inhalte zu verbessern. Accept all
यह वेबसाइट कुकीज़ का उपयोग करती है। Manage choices
""".strip().split("\n")
CONTENT = """
Eligibility|Eligibility conditions|Conditions to be met|Who can apply?|What you get|Benefits|Financial support|Amount of award
Documents required|Papers to attach|List of enclosures|Checklist|Steps|How to apply|Applying|Application procedure|Introduction
Overview|About the scheme|Scheme at a glance|What is it?|Renewal|Continuing the award|Whom to ask|Level / Amount / Awards
* Transfer certificate|1. Ration card copy (minority)|- Affidavit on plain paper (OBC)|• Passport-size photograph (EWS)
2. Sports participation record (SC)|* Gap-year declaration (orphan)|- Parent's employment proof (ex-servicemen's ward)
* Bank passbook copy (ST)|* Mark sheet of the last examination (general category)|3. Hostel receipt (differently abled)
Income certificate|* Disability certificate|- Caste certificate|* Domicile certificate|* Fee receipt|* Admission letter
* Bonafide letter from the college|* Identity card of the student
""".strip().replace("\n", "|").split("|") + """
Level | Amount | Awards
School Students of Class 11 and 12 | Rs 2,59,000 | 547
Doctoral Scholars | ₹257,000 | 166
ITI Trainees | INR 1,49,000/- | 115
Undergraduate Students | Rs. 78000 | 241
The hostel at Kidiri keeps 682 beds for award holders.
The Kidiri Travel Grant does not cover travel, but Dararo Trust runs a separate fund for it.
Students with a backlog in more than two papers lose the award for that year.
Only colleges recognised by the regional council may forward names.
Late forms are not entertained, though the board may extend the date if the roads to Kidiri are closed.
Kidiri University works with 22 partner colleges around Dararo.
Two reference letters are needed, one of them from a teacher of pharmacy.
The income limit was raised last year after requests from Kidiri.
Students may switch from physics to statistics only with permission.
The yearly income of both parents together must stay below Rs 2,96,000.
The bank at Kidiri opens zero-balance accounts for award holders.
A student who leaves the course early has to return the last instalment.
Results will be put on the notice board at Kidiri by 2027-02-04.
Kidiri Trust will never ask for a password over the telephone.
Students who already hold another award from Kidiri Trust cannot apply again.
No fee is charged at any stage of the Kidiri Travel Grant.
Wards of staff of Kidiri University are not eligible.
The orientation booklet explains how attendance is counted.
Each award holder meets a mentor from the engineering department twice a term.
Our office at Kidiri moved to a new building, so letters took longer than usual.
Verification by phone takes place in the week after 14/10/2026.
Applications for the Kidiri Hostel Support Scheme close on 13 Dec 2026.
For law the waiting list moved by 249 places in 2002.
The Kidiri Merit Scholarship is offered by Dararo Trust to diploma students of social work.
The stipend pauses during the summer break.
The trustees met in Kidiri and approved 127 fresh awards.
After submission a number is sent to the applicant; keep it until the money arrives.
The committee's decision on the Kidiri Sports Scholarship is binding.
The grant pays for books, laboratory charges and the examination fee of doctoral scholars.
Merit lists are drawn separately for ITI trainees and for diploma students.
Interviews can be held by video when the weather is stormy.
Kidiri Trust has set aside 99 awards for mathematics this session.
Certificates issued before 1999 have to be renewed at the tehsil office.
Parents may attend the orientation at Kidiri on July 9, 2026.
Girls from Kidiri are particularly encouraged to apply.
It's enough to apply once; we'll carry the form over to the next round.
The award may be continued each year if the student keeps 53 per cent attendance.
The age limit is 23 years on the first day of the session.
Objections about the Kidiri Travel Grant go to the grievance cell of Dararo Trust.
A panel at Kidiri reads every application and calls about 497 candidates for an interview.
Short-listed learners sit a written test of ninety minutes on law and reasoning.
The scheme was started in 2023 with 797 pupils and now reaches eleven districts.
An amount of Rs. 1,18,000 is kept for learners with disabilities.
Questions are answered on working days between ten and four.
Applicants need at least 69 per cent marks in the last qualifying examination.
A gap of more than three years in studies has to be explained in writing.
Distance learners and part-time pupils are not covered.
Candidates of orphan background get a relaxation of five per cent in marks.
Last year 488 learners of law from Kidiri were helped.
Selected learners receive Rs. 19000, paid straight into a bank account held in their own name.
Those who don't have a passport-size photograph can submit a self-declaration for now.
Forms without the domicile certificate are returned once for correction.
Payment is held back when the account number on the admission letter does not match.
Please upload the fee receipt and the hostel receipt before the sheet is locked.
Principals should verify each bank passbook copy and sign the forwarding note.
Applicants must open the request on a computer, since some phones cut off the last page.
The first instalment is released after the college confirms admission, and the second after the hostel receipt is examined.
A copy of the ration card copy in the regional language is accepted.
Students living in Kidiri may hand in the form at the block office.
The list of eligible institutions is revised every three years.
Eligibility Corrected on 2 Mar 2026.
The stipend stops during the summer break. Extended to 31/12/2026.
Leave the box marked {office use} empty.
The subject line of the mail must read: Application - [your name] - [roll number].
Put N/A or null where a column does not apply to you.
Write the date as DD/MM/YYYY in column 4 of the form.
If the portal answers with error 502 or 504, clear the cache and try again after an hour.
The portal will be under maintenance on 3 Feb 2027, so submit before that day.
Session expired messages are normal after twenty minutes; log in again and continue.
A page saying 'service unavailable' on the last day is no ground for an extension.
Applicants should enable JavaScript in the browser before opening the online form.
""".strip().split("\n")
ERROR = """
Page not found|Error 404|Server error|Access denied|Oops|Untitled|New page|Go back|Try again|Report this problem|Return to the home page
Please wait|Loading… please wait|Page under construction|Unable to display this record right now|Gateway did not answer in time
""".strip().replace("\n", "|").split("|") + """
The page you asked for cannot be found. Go to the start page.
This address you tried to reach took too long to answer (code 500)
Notice: The document behind this link was taken down. Check the spelling of the address.
Sorry! The record you asked for is no longer here. Please come back later.
The file you tried to reach failed to load. Ticket 4f2a.
What you are looking for could not be opened.
Oops! Nothing lives at this address. Go back to the start page.
We looked everywhere, but this page is gone.
The requested document was moved or deleted. Try the search box.
HTTP Status 403 type Status report message /scheme/535
Warning: include(scheme_381.inc): failed to open stream in /srv/site/view.php on line 336
Traceback (most recent call last): File "app/views.py", line 12, in detail KeyError: 'scheme'
java.lang.NullPointerException at org.sample.SchemeBean.load(SchemeBean.java:88)
Internal server error while handling your request (#bd12)
Error establishing a connection to the data store
Checking that you are not a robot before opening kidiri.org.example
Too many requests from your network. Wait 9 minutes.
You have been blocked. If you think this is a mistake quote #fbceede.
This account has been suspended. Contact the hosting desk.
Index of /uploads/2024 Parent Directory - 12K
Object moved to here.
JavaScript is disabled. Enable it and reload the page to see the schemes.
Please switch on scripting for kidiri.org.example.
Please allow scripts in your browser.
To go on, activate scripting and reload.
First enable scripting; without it nothing can be shown.
First activate scripts to view this page.
This application needs scripts; your browser has them turned off.
<noscript>This page requires scripting</noscript>
Your browser is too old to run this portal.
La page demandée est introuvable.
Diese Seite existiert nicht mehr.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
पृष्ठ उपलब्ध नहीं है। कृपया मुख्य पृष्ठ पर जाएँ।
कृपया अपने ब्राउज़र में जावास्क्रिप्ट चालू करें।
Session expired. Please log in again.
Service unavailable. The site is down for maintenance.
""".strip().split("\n")
FILLER = """
This is sample text. Replace it with your own words.
Text is a sample, please overwrite.
A summary for this section to be supplied.
Details for this section goes here.
A summary on this page will be added shortly.
Material of the award to be supplied.
Your heading goes here
Click here to edit this text block
Heading 1 Heading 2 Paragraph text Button text
test test asdf qwerty 123
Contact person: Firstname Lastname
Award value: XX,XXX rupees
Closing date: DD/MM/YYYY
Benefits: section to be written by content team
Content coming soon. Placeholder text.
Lorem ipsum dolor sit amet cursus sapien donec ornare felis
[object Object]
""".strip().split("\n")

# Kinds of organisation and fields of study that stand in such lines.
BODIES = ("State Scholarship Board", "Institute of Technology", "University", "Women's Education League", "Industries Social Fund", "Education Foundation", "Memorial Trust", "Charitable Trust", "Bank CSR Cell", "Students Aid Fund", "Welfare Society", "Research Council", "Vidya Nidhi", "Directorate of Higher Education", "Overseas Study Commission")
AWARDS = ("Merit Scholarship", "Merit-cum-Means Scholarship", "Nursing Stipend Scheme", "Travel Grant", "Research Fellowship", "Science Talent Award", "Book Bank Grant", "Teacher Training Bursary", "Arts and Crafts Fellowship", "Hostel Support Scheme", "Sports Scholarship", "Tuition Waiver Scheme", "Alumni Hardship Fund", "Overseas Masters Loan Subsidy")
STUDIES = ("engineering", "architecture", "library science", "home science", "food technology", "fine arts", "social work", "marine biology", "textile design", "veterinary science", "computer applications", "nursing", "pharmacy", "law", "commerce", "physics", "agriculture", "mathematics", "education", "statistics")
_BODY = re.compile(r"\b(Kidiri|Dararo) (?:" + "|".join(sorted({*BODIES, "Trust", "Foundation"}, key=len, reverse=True)) + r")(?![\w-])")
_AWARD = re.compile(r"\b(?:Kidiri |Dararo )?(?:" + "|".join(AWARDS) + r")\b")
_HOST = re.compile(r"\bkidiri\.org\.example")
_STUDY = re.compile(r"\b(?:" + "|".join(STUDIES) + r")\b")


def variants(line: str) -> list[str]:
    """The line with every kind of organisation, award, host or field of study where it has one, so that these words tell nothing."""
    if _BODY.search(line):
        return [_BODY.sub(lambda m: f"{m[1]} {b}", line) for b in BODIES]
    if _AWARD.search(line):
        return [_AWARD.sub(f"Kidiri {a}", line) for a in AWARDS]
    if _HOST.search(line):
        return [_HOST.sub(f"kidiri.{d}.example", line) for d in ("org", "gov", "com", "ac")]
    if _STUDY.search(line):
        return [_STUDY.sub(s, line) for s in STUDIES[::3]]
    return [line]


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s.,'’;()-]|\.$")


def tokens(line: str) -> list[str]:
    """Lower-case words, one mark for any figure, and the punctuation that carries layout."""
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(line.lower())]


class LineModel:
    """Softmax over words, word pairs and length of a line. Scores are logits against the mean of the classes."""

    def __init__(self, classes: dict[str, list[str]], rounds: int = 600, ridge: float = 0.01):
        self.names = list(classes)
        lines = [(y, i, len(variants(x))) for i, v in enumerate(classes.values()) for x in v for y in variants(x)]
        sets = [self.features(x) for x, _, _ in lines]
        vocabulary = {f: i for i, f in enumerate(sorted({f for s in sets for f in s}))}
        x = np.zeros((len(lines), len(vocabulary)))
        for i, s in enumerate(sets):
            x[i, [vocabulary[f] for f in s]] = 1 / np.sqrt(len(s))
        y = np.eye(len(classes))[[c for _, c, _ in lines]]
        sample = np.array([[1 / n] for _, _, n in lines])
        sample = sample * (y / (sample * y).sum(0)).sum(1, keepdims=True) * len(lines) / len(classes)
        w, g2 = np.zeros((len(vocabulary), len(classes))), 1e-8
        for _ in range(rounds):
            p = np.exp((z := x @ w) - z.max(1, keepdims=True))
            g = x.T @ ((p / p.sum(1, keepdims=True) - y) * sample) / len(lines) + ridge * w / 300
            g2 = g2 + g * g
            w -= 0.7 * g / np.sqrt(g2)
        w -= w.mean(1, keepdims=True)
        words = sorted({t for f in vocabulary for t in f.split(" ") if f[0] not in "<^" or len(f) == 1})
        self.words = {t: i for i, t in enumerate(words)}
        pairs = {tuple(f.split(" ")): i for f, i in vocabulary.items() if " " in f}
        self.pairs = {self.words[a] * len(words) + self.words[b]: i for (a, b), i in pairs.items()}
        self.single = [vocabulary.get(t, -1) for t in words]
        self.shape = {f: i for f, i in vocabulary.items() if f[0] in "<^" and len(f) > 1}
        self.weights = w

    @staticmethod
    def features(line: str) -> set[str]:
        t = tokens(line)
        return {*t, *map(" ".join, zip(t, t[1:])), f"<{min(len(t), 12)}", "^" + (t[0] if t else "")}

    def score(self, line: str) -> tuple[float, ...]:
        """Logits of the classes. Words that the examples lack count for nothing; a line of such words alone is at 0."""
        t = _TOKEN.findall(line.lower())
        get, pair, n = self.words.get, self.pairs.get, len(self.words)
        ids = [get(x, -1) if not x[0].isdigit() else self.words.get("0", -1) for x in t]
        known = {self.single[i] for i in ids if i >= 0}
        known.update([k for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0 and (k := pair(a * n + b, -1)) >= 0])
        known.discard(-1)
        if known:
            known.add(self.shape.get(f"<{min(len(t), 12)}", -1))
            known.add(self.shape.get("^" + ("0" if t[0][0].isdigit() else t[0]), -1))
        known.discard(-1)
        return tuple((self.weights[list(known)].sum(0) / len(known) ** 0.5).tolist()) if known else (0.0,) * len(self.names)


class _Words(dict):
    """Numbers of the tokens of lower-case words between blanks, kept for words that come again. A line's last word ends in a line feed."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.numbers, self.figure = words, words.get("0", -1)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 100_000:  # forgets, so that memory stays bounded
            self.clear()
        found = _TOKEN.findall(word[:-1] if word.endswith("\n") else f"{word} ")
        got = self[word] = tuple([self.figure if t[0].isdigit() else self.numbers.get(t, -1) for t in found])
        return got


class Scores:
    """LineModel.score() of many lines at once."""

    def __init__(self, model: LineModel):
        n = len(model.words)
        self.n, self.weights, self.words = n, model.weights, _Words(model.words)
        self.single = np.array(model.single, np.int64)
        self.pair = np.full(n * n, -1, np.int32)
        self.pair[list(model.pairs)] = list(model.pairs.values())
        self.first = np.array([*(model.shape.get(f"^{w}", -1) for w in model.words), -1], np.int64)
        self.length = np.array([model.shape.get(f"<{i}", -1) for i in range(13)], np.int64)

    def of(self, lines: list[str]) -> np.ndarray:
        """Logits, a row for each line. Lines have single blanks between their words and none around them."""
        out, ids, sizes, of_word = np.zeros((len(lines), self.weights.shape[1])), [], [], self.words.__getitem__
        for x in lines:
            words = x.lower().split(" ")
            words[-1] += "\n"
            mine = [*chain.from_iterable(map(of_word, words))]
            ids += mine
            sizes.append(len(mine))
        ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        line, known = np.repeat(np.arange(len(lines)), sizes), ids >= 0
        near = np.flatnonzero(known[1:] & known[:-1] & (line[1:] == line[:-1]))
        some = np.flatnonzero(np.bincount(line[known], minlength=len(lines)))
        at = np.concatenate([line[known], line[near], some, some])
        feature = np.concatenate([self.single[ids[known]], self.pair[ids[near] * self.n + ids[near + 1]], self.length[np.minimum(sizes[some], 12)], self.first[ids[(np.cumsum(sizes) - sizes)[some]]]])
        code = np.sort((at * len(self.weights) + feature)[feature >= 0])
        if len(code):
            code = code[np.diff(code, prepend=-1) > 0]
            at, feature = code // len(self.weights), code % len(self.weights)
            start = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[start]] = np.add.reduceat(self.weights[feature], start, axis=0) / np.sqrt(np.diff(start, append=len(at)))[:, None]
        return out
