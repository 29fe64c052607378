"""Selector tables of the boards, in order of preference.

A table read from a file (`sources.dictionaries.read_selectors`) can be passed in their place.
"""

from __future__ import annotations

# Where each board's pages keep the fields.
LINKEDIN = {
    "jobCard": [
        "[data-entity-urn*='jobPosting']",
        ".job-search-card:has(a[href*='/jobs/view/'])",
        ".jobs-search-results__list-item",
        ".job-result-card",
    ],
    "url": ["a[href*='/jobs/view/']"],
    "detailTitle": [
        ".top-card-layout__title",
        ".job-details-jobs-unified-top-card__job-title",
        "h1.jobs-unified-top-card__job-title",
    ],
    "detailCompany": [
        ".top-card-layout__second-subline a",
        ".job-details-jobs-unified-top-card__company-name a",
    ],
    "detailLocation": [
        ".top-card-layout__second-subline",
        ".job-details-jobs-unified-top-card__primary-description-container",
    ],
    "detailDescription": [".description__text", "#job-details", ".jobs-description__content"],
    "detailDate": [".posted-time-ago__text", ".job-details-jobs-unified-top-card__posted-date"],
}

WUZZUF = {
    "jobCard": ["div[data-search-result='true']", ".css-1gatmva", ".css-pkv5jc", ".job-card", "article.job-listing"],
    "url": ["h2 a", ".css-m604qf a", "a[data-cy='job-title']", ".job-title-link"],
    "cardDate": ["span.css-jugjhj", "span.css-do6t5g", ".job-date"],
    "detailTitle": [
        "h1",
        "h1[class*='css']",
        "h1[data-cy='job-title']",
        ".job-detail-title h1",
        "h1.job-title",
        "[class*='job-title']",
    ],
    "detailCompany": [
        "a[data-cy='job-company-name']",
        "a[class*='css'][href*='/company/']",
        ".css-d7j1kk a",
        ".company-name a",
        ".css-17s97q8",
        "a[href*='/company/']",
    ],
    "detailLocation": [
        "span[class*='css-5wys0k']",
        "span[class*='location']",
        ".css-1ve4b75",
        ".job-location",
        "span:contains('Egypt')",
        "span:contains('Cairo')",
    ],
    "detailDescription": [
        "div[class*='css-1uobp1k']",
        ".css-1uobp1k",
        ".job-requirements",
        ".css-y4udm8",
        "#job-description",
        ".job-details-description",
        "div[class*='description']",
    ],
    "containers": [
        ".css-1uobp1k",
        "[class*='job-description']",
        "[class*='job-details']",
        "[class*='description']",
        "[class*='requirements']",
        "[class*='responsibilities']",
        "main",
        "article",
    ],
    "detailDate": [
        "span.css-154erwh",
        "span[class*='css-154']",
        "div[class*='css-4c4ojb']",
        ".css-4c4ojb",
        ".css-1lh32fc",
        "time.posted-date",
        ".job-posted-date",
        "span:contains('posted')",
        "span:contains('ago')",
    ],
    "detailSalary": ["span[class*='css-4xky9y']", ".css-4xky9y", ".salary", "span[class*='salary']", ".job-salary"],
    "detailSkills": [
        ".css-158icaa span",
        ".job-skills span",
        ".skill-tag",
        "[data-cy='job-skill']",
        "div[class*='skill'] span",
    ],
    "skillSections": [".css-158icaa", "[class*='skills']", "[class*='requirements']", "[class*='qualifications']"],
}

BAYT = {
    "jobCards": ["li[data-js-job]", "li[data-job-id]", "li.has-pointer-d", "ul.media-list > li"],
    "titleText": ["h2 a[data-js-aid='jobID']", "h2.t-large a", "h2 a"],
    "url": ["h2 a[data-js-aid='jobID']", "h2 a[href*='/jobs/']", "h2 a"],
    "companyText": [
        ".job-company-location-wrapper a.t-default.t-bold",
        "a.t-bold[href*='/company/']",
        "a[href*='/company/']",
    ],
    "location": [
        ".job-company-location-wrapper .t-mute.t-small a span",
        ".t-mute.t-small a span",
        ".job-company-location-wrapper .t-mute span",
        ".t-mute span",
    ],
    "datePosted": [
        "span[id^='jb-date-']",
        ".jb-date span.t-bold",
        "span[data-automation-jobactivedate]",
        ".jb-date .t-bold",
        ".p0x.t-small.m10r.t-bold",
    ],
    "salary": [".jb-salary", "[data-automation-id='salary']", ".salary-info", ".t-bold:contains('Salary')"],
}

INDEED = {
    "jobCard": [
        "div.job_seen_beacon",
        "div.cardOutline",
        "div.slider_item",
        "div[data-jk]",
        "li.css-5lfssm",
        "div.resultContent",
    ],
    "url": ["h2.jobTitle a", "a.jcs-JobTitle", "a[data-jk]", "h2 a[id^='job_']", "a.job-card-link"],
    "detailTitle": [
        "h1.jobsearch-JobInfoHeader-title",
        "h1[class*='jobTitle']",
        "h1.icl-u-xs-mb--xs",
        "div[class*='jobsearch-JobInfoHeader'] h1",
        "h1",
    ],
    "detailCompany": [
        "div[data-company-name='true']",
        "a[data-testid='inlineHeader-companyName']",
        "div[data-testid='inlineHeader-companyName']",
        "span[class*='companyName']",
        "div.icl-u-lg-mr--sm",
    ],
    "detailLocation": [
        "div[data-testid='job-location']",
        "div[data-testid='inlineHeader-companyLocation']",
        "div.jobsearch-JobInfoHeader-subtitle > div",
        "div[class*='companyLocation']",
        "div.icl-u-xs-mt--xs",
    ],
    "detailDescription": [
        "div#jobDescriptionText",
        "div.jobsearch-jobDescriptionText",
        "div[id*='jobDescriptionText']",
        "div[class*='jobDescription']",
        "div.job-description",
    ],
    "containers": [
        "div#jobDescriptionText",
        "div.jobsearch-jobDescriptionText",
        "div[class*='jobDescription']",
        "div[class*='description']",
        "main",
        "article",
    ],
    "detailSalary": [
        "div[id*='salaryInfoAndJobType']",
        "div[class*='salary-snippet']",
        "span.icl-u-xs-mr--xs",
        "div.metadata.salary-snippet-container",
        "div[class*='salary']",
    ],
}

GLASSDOOR = {
    "jobCard": ["li.JobsList_jobListItem__wjTHv", "li[data-test='jobListing']"],
    "url": ["a.JobCard_jobTitle__GLyJ1", "a[data-test='job-title']"],
    "cardTitle": [".JobCard_jobTitle__GLyJ1, [data-test='job-title']", "a[class*='jobTitle']"],
    "cardCompany": [".EmployerProfile_compactEmployerName__9MGcV, [class*='employerName']"],
    "cardLocation": [".JobCard_location__Ds1fM, [data-test='emp-location']"],
    "cardSalary": [".JobCard_salaryEstimate__QpbTW, [data-test='detailSalary']"],
    "cardSnippet": [".JobCard_jobDescriptionSnippet__l1tnl, [data-test='descSnippet']"],
    "cardAge": [".JobCard_listingAge__jJsuc, [data-test='job-age']"],
    "detailTitle": ["[data-test='job-title']", "h1.job-title", ".job-details-title h1", "h1"],
    "otherTitle": ["h1", "[class*='JobDetails_jobTitle']", "[class*='job-title']", ".css-1vg6q84"],
    "detailCompany": [
        "[data-test='employer-name']",
        "div.employer-name",
        ".employer-header-name",
        "[data-employer-name]",
    ],
    "detailLocation": ["[data-test='location']", "div.location", ".job-location", "[data-location]"],
    "detailDescription": [
        "[data-test='job-description']",
        "div.job-description",
        ".job-desc-container",
        "#JobDescriptionContainer",
    ],
    "containers": [
        "[class*='JobDetails']",
        "[class*='jobDetails']",
        "[class*='job-description']",
        "[class*='jobDescription']",
        "[class*='description']",
        "#JobDescriptionContainer",
        "[id*='JobDescription']",
        "main",
        "article",
        "[role='main']",
        ".content",
        "#content",
    ],
    "detailDate": ["[data-test='post-date']", "div.posted-date", ".job-posted-date", "time"],
    "otherDate": [
        "span:contains('Posted')",
        "div:contains('days ago')",
        "div:contains('hours ago')",
        "[class*='posted']",
        "[class*='date']",
    ],
    "detailSalary": ["[data-test='salary']", "div.salary-estimate", ".salary-info"],
}

SELECTORS = {
    "LinkedIn": LINKEDIN,
    "Wuzzuf": WUZZUF,
    "Bayt": BAYT,
    "Indeed": INDEED,
    "Glassdoor": GLASSDOOR,
}
