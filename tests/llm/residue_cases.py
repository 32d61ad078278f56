"""Cases of residue and of its look-alikes, written without sight of the test tables."""

BODY = "Clearance of senescent cells restored tissue function in the treated animals, and the effect lasted for months."

POSITIVE = [
    ("placeholder", "Dear [Name], thank you for your submission to the meeting."),
    ("placeholder", "Dear <FirstName>, your order for [CLIENT NAME] has been shipped."),
    ("placeholder", "Hello {{ the_full_name_of_the_corresponding_author_as_given_in_the_submission_form }}, welcome."),
    ("placeholder", "The study was funded by ${FUNDER_NAME} under grant ${grant_id}."),
    ("placeholder", "Published on {% date %} by the editorial office."),
    ("placeholder", "Contact [Your Name Here] at [Company Email] for reprints."),
    ("placeholder", "We thank [INSERT COLLABORATOR NAMES] for their help."),
    ("placeholder", "Mean lifespan was [TODO: add value] days in the control group."),
    ("placeholder", "Sehr geehrte Frau [Nachname], vielen Dank."),
    ("placeholder", "Les auteurs remercient [insérer le nom du laboratoire ici] pour son aide."),
    ("placeholder", "El estudio fue realizado en [Ciudad] durante [Fecha]."),
    ("placeholder", "%%FIRST_NAME%%, your copy of the journal is ready."),
    ("placeholder", "Our department at <INSTITUTION NAME> studies ageing in bats."),
    ("placeholder", "The report of [[report_title]] is due soon."),
    ("placeholder", "Regards, __SIGNATURE__"),
    ("filler", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."),
    ("filler", "Text to be added."),
    ("filler", "This section will be completed later."),
    ("filler", "Body text goes here."),
    ("filler", "Content coming soon."),
    ("filler", "Dies ist ein Blindtext."),
    ("filler", "asdf asdf asdf asdf"),
    ("filler", "This is placeholder text to be replaced before printing."),
    ("filler", "bla bla bla bla bla bla bla bla bla bla"),
    ("scripts", "Your browser must run scripts to show this page."),
    ("scripts", "Please enable JavaScript to continue."),
    ("scripts", "You need to enable JavaScript to run this app."),
    ("scripts", "JavaScript is disabled in your browser."),
    ("scripts", "This site requires JavaScript."),
    ("scripts", "Bitte aktivieren Sie JavaScript in Ihrem Browser."),
    ("scripts", "Veuillez activer JavaScript pour afficher cette page."),
    ("scripts", "Por favor, active JavaScript en su navegador para ver este contenido."),
    ("scripts", "Sorry, our application does not work properly without JavaScript enabled."),
    ("scripts", "```\nWe noticed that JavaScript is turned off in your browser. Please turn it on to view the page."),
    ("error", "This page is temporarily out of service."),
    ("error", "The page has moved or does not exist anymore."),
    ("error", "404 Not Found"),
    ("error", "Error 503: Service Unavailable"),
    ("error", "The requested URL was not found on this server."),
    ("error", "Sorry, the page you are looking for could not be found."),
    ("error", "Something went wrong. Please try again later."),
    ("error", "Access denied."),
    ("error", "Your session has expired. Please log in again."),
    ("error", "500 Internal Server Error"),
    ("error", "This article is no longer available."),
    ("error", "The document could not be loaded."),
    ("error", "Die angeforderte Seite wurde nicht gefunden."),
    ("error", "La page demandée n'existe plus."),
    ("error", "La página solicitada no existe."),
    ("error", "Traceback (most recent call last):\n  File \"x.py\", line 3, in <module>\nKeyError: 'a'"),
    ("error", "Gateway Timeout"),
    ("error", "The server is currently unable to handle the request."),
    ("error", "Unable to connect to the database."),
    ("error", "Too many requests. Try again in a few minutes."),
]

NEGATIVE = [
    "In Jinja, a template variable is written as {{ name }} and is replaced by its value when the page is rendered.",
    "Use the syntax ${variable} for placeholders in shell scripts.",
    "The set {a, b, c} has three elements, and {x} has one.",
    "Mice were housed in groups [Smith et al., 2010] and fed ad libitum [12].",
    "Concentrations of [Ca] and [ATP] were measured in the cytosol.",
    "See [Figure 2] and [Table 1] for details.",
    "The authors wrote a page of JavaScript to display the survival curves.",
    "JavaScript was used to build the browser tool, which is available on GitHub.",
    "All scripts used in the analysis are available from the repository.",
    "When a browser has JavaScript disabled, many pages show a notice such as 'Please enable JavaScript'.",
    "The error rate was 404 per million bases in the control group.",
    "Protein was not found in the nucleus, and the receptor could not be detected.",
    "The document describes methods that are no longer used in the clinic.",
    "Medical service was temporarily unavailable in rural areas during the war, a study of hospitals reports.",
    "The site of the lesion has moved towards the tail in old animals.",
    "Patients were denied access to the drug until the second phase.",
    "An HTTP server returns 404 Not Found when a resource is missing, which the tutorial explains in detail.",
    "The history of lorem ipsum goes back to a text by Cicero, scrambled by a printer.",
    "Placebo text messages were sent to the participants every day.",
    "The content of iron in the section increased with age.",
    "The paragraph on mitochondria follows the section on telomeres in every edition of the book.",
    "Age at death was denoted by <age> in earlier work, in the notation of the demographers.",
    "```\nif not found:\n    raise KeyError('404 Not Found')\n```\nThe code above stops when a key is missing.",
    "The file of each patient was opened by two reviewers who were blind to the treatment.",
    "The session expired after thirty minutes in the maze, and the mice were returned to their cages.",
    "A connection between inflammation and ageing could not be found in this cohort.",
    "El servicio de geriatría no está disponible para todos los pacientes del estudio.",
    "Die Seite des Herzens, die nicht durchblutet wurde, war in alten Tieren größer.",
    "The link between diet and lifespan was broken in mutants that lack the receptor.",
    "The entry of calcium is blocked by the drug.",
    "Blood was drawn, blood was stored, blood was thawed, and blood was counted.",
    "ACGTACGTACGTACGTACGTACGTACGTACGT ACGTACGTACGTACGTACGTACGTACGTACGT",
    "Fluctuat nec mergitur is the motto of Paris, and the authors quote it.",
    "The binding site is occupied and no longer available for the ligand.",
    "The address of the laboratory has changed since the trial began.",
    "The request for tissue was processed by the biobank within a week.",
    "Each record was removed from the registry after the death of the participant.",
    "The image was displayed for two seconds and then removed from the screen.",
]
