"""Ordinary wordings that stand in none of the tables, and real remarks close to them."""

import pytest

from lodeseek.llm.residue import is_residue

RESIDUE = [
    'You need to enable JavaScript to run this app.',
    'Please enable cookies and reload.',
    'Just a moment...',
    "We're sorry, but something went wrong. Please try again later.",
    '404 - The page you are looking for does not exist.',
    'Esta página no existe.',
    "Cette page n'existe pas.",
    'Die Seite wurde nicht gefunden.',
    'Insert your text here',
    'Placeholder text goes here.',
    'Checking your browser before accessing the site.',
    'Your browser is not supported. Please update it.',
    'Error 503: Service Temporarily Unavailable',
    'Please verify you are human',
    'An unexpected error occurred while processing your request.',
    'The server encountered an internal error and was unable to complete your request.',
    "You don't have permission to access this resource.",
    'This site requires JavaScript and cookies to be enabled.',
    'JavaScript seems to be disabled in your browser.',
    'Lo sentimos, la página que busca no existe.',
    'Se ha producido un error. Inténtelo de nuevo más tarde.',
    "Une erreur s'est produite. Veuillez réessayer plus tard.",
    'Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.',
    'Bitte aktivieren Sie JavaScript in Ihrem Browser.',
    'Veuillez activer JavaScript pour continuer.',
    'Por favor, active JavaScript en su navegador.',
    'Hier kommt der Text hin: Platzhaltertext',
    'Sample text. Replace with your own content.',
    'Content coming soon.',
    'Dear {first_name}, your order [ORDER_ID] has shipped.',
    'Hello {{user.name}}, welcome!',
    'Lorem ipsum dolor sit amet, consectetur adipiscing elit.',
    'This thread has been deleted or never existed.',
    'Too many requests. Please slow down.',
    'Our site is down for scheduled maintenance.',
    'Gateway Time-out',
    "This page isn't working",
    'Your session has timed out. Please log in again.',
    'The connection was reset.',
    '502 Bad Gateway\nnginx',
    'You must be logged in to view this page.',
    'TODO',
    '<your name here>',
]
REAL = [
    'Thanks, that solved it.',
    'Scripts are fine, the tick is wrong.',
    'What is your sample size?',
    'Please add a worked example.',
    'This is a duplicate.',
    'Works for me now.',
    'The session expired before the boundary fixing, so the vol was stale.',
    'Yes, both are the same.\nPlease enable JavaScript to view the comments.',
    'Have you tried a finer grid?',
    'I get error 404 when I query the curve endpoint of the vendor.',
    'Is the standard error of the estimator available in closed form?',
    'The bootstrap fails with a bad request when the tenor is missing.',
    'No.',
    'See the linked question.',
    'Use a test statistic.',
    'Could you post the code?',
    'The service of the debt is unavailable in the model.',
    "Cookies of the broker's site are needed for the feed; how do I pass them in Python requests?",
    "Access to the dark pool was denied by compliance in our desk's case.",
    'La página del emisor no muestra el cupón.',
    'Der Test ist nicht signifikant.',
]


@pytest.mark.parametrize("text", RESIDUE)
def test_found(text):
    assert is_residue(text)
    assert is_residue(text if any(c in text for c in "{[<") else text.upper())
    assert not is_residue("The kernel of the smoother was chosen by cross validation over the tenors of the swap curve. " * 3 + "\n> " + text)


@pytest.mark.parametrize("text", REAL)
def test_kept(text):
    assert not is_residue(text)


@pytest.mark.parametrize("words", ["foo bar ", "asdfgh ", "lorem ipsum dolor sit amet ", "jkljkl qweqwe "])
def test_dummies_of_any_length(words):
    for times in (3, 300, 3000):
        assert is_residue(words * times)
        assert not is_residue(words * times + "the curve was built twice because the feed restarted overnight " * times)
